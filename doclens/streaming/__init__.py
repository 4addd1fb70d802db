"""Incremental forms of operators, as Structured Streaming queries."""

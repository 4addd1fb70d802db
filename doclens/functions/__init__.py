"""Column functions: text, patterns, similarity."""

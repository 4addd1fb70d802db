"""The registered queries and, where SQL can express them, their equivalents."""

from . import registry
from . import comparison, compliance, composed, documents, entities, feedback, graph, learning, more, phrases, retrieval, stores, stream  # noqa: F401  they register


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)

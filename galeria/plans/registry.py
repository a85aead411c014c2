"""All registered queries of the library's own operators."""

from __future__ import annotations

from galeria.plans import catalog_queries, event_queries, vector_queries  # noqa: F401  the latter two register theirs


def queries() -> dict:
    """Query functions by name."""
    return dict(catalog_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(catalog_queries.ORACLES)

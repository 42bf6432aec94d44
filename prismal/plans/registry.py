"""The queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import every module of queries."""
    from prismal.plans import archive, evaluation, models, patches, queries, shapes, strips  # noqa: F401

"""Named queries over the given tables, each with its ANSI SQL counterpart where one exists."""

from wattmill.queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

"""Registry of queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 8
MODULES = ("meter", "quality", "bills", "verify", "extract", "spatial", "sources", "whole", "intake")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to DIGITS decimals, for the comparison with SQL alone: the two engines add in different orders."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
        for c in df.columns
    ])


def rounded_sql(body: str, doubles: str, ctes: str = "", digits: int = DIGITS) -> str:
    """Wrap a SELECT so that the named columns are rounded the same way."""
    cols = [c.strip() for c in doubles.split(",") if c.strip()]
    head = f"WITH {ctes}\n" if ctes else ""
    if not cols:
        return head + body
    items = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
    return f"{head}SELECT * REPLACE ({items}) FROM (\n{body}\n) AS r"


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query; `digits` where results often end on half a unit of the usual last digit."""
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"wattmill.queries.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

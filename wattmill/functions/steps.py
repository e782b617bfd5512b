"""Columns in a step of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, each evaluated once per row however often it is used above.

    Catalyst copies a projected expression into every filter and projection that it merges with. A generator of one row
    is no projection: what refers to its columns stays above it, and filters on other columns still go down to the scan.
    """
    if not columns:
        return df
    row = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(row))


def computed_once(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key, for several branches of a query to read: Spark runs what is below once and reuses its shuffle.

    Branches that use other columns would each prune the shuffle in their own way and so run everything again. The number
    in the packed row is not deterministic, and no column is pruned below such a step.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = df.repartition(parts, key).select(F.struct("*", F.monotonically_increasing_id().alias("_n")).alias("_row"))
    return packed.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def by_merge(df: DataFrame) -> DataFrame:
    """df, never broadcast by a join: for tables that grow with the input.

    Spark guesses the size of a derived table from the file of its source. One that holds far more than its source, as the
    texts and fields made of an order do, would pass for a small one and be gathered by the driver.
    """
    return df.hint("merge")

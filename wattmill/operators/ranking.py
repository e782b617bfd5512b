"""Numbering rows of groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order_date: str,
    order_id: str,
    position: str = "position",
    total: str = "group_rows",
    bucket_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 1-based position of each row in its group (by date, nulls last, then a numeric id) and the group size.

    A group is cut by date and id range; only the row counts of those cuts meet in one window, and each row
    gets the offset of its cut plus its place inside it.  Null group keys count as a value of their own.
    """
    cuts = df.withColumn("_date", F.coalesce(F.col(order_date), F.lit("9999-12-31").cast("date"))).withColumn(
        "_cut", F.floor(F.col(order_id) / bucket_rows)
    )
    keys = [*group, "_date", "_cut"]
    ahead = Window.partitionBy(*group).orderBy("_date", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cuts.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(order_id)
    return (
        cuts.join(offsets, keys)
        .withColumn(position, F.row_number().over(inside) + F.col("_offset"))
        .select(*df.columns, position, total)
    )

"""Meter reads to clean interval readings: parsing, time zone, units, import/export, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.functions import calendar as cal
from wattmill.functions.dates import parse_read_time
from wattmill.functions.numbers import to_number

def localise(df: DataFrame, wall: str = "datetime") -> DataFrame:
    """Add `datetime_utc` and put the wall time on the Dublin clock (moves the missing spring hour)."""
    return df.withColumn("datetime_utc", cal.dublin_wall_to_utc(F.col(wall))).withColumn(
        wall, cal.utc_to_dublin_wall(F.col("datetime_utc"))
    )


def file_units(raw: DataFrame) -> DataFrame:
    """One row per file: does its first read say kW rather than kWh?"""
    first = F.min_by("read_type", "row_idx")
    return raw.groupBy("file_id").agg(
        (first.contains("kW)") & ~first.contains("kWh")).alias("is_kw")
    )


def file_reads(raw: DataFrame) -> DataFrame:
    """Long reads (file_id, row_idx, mprn, read_value, read_type, read_time) to one row per file, meter and instant.

    Import and export become columns, a missing export is 0, instants with exports only are dropped and
    kW files are halved.  Reads are summed per (file, mprn, instant) with map-side combine, so a meter that owns
    most of the rows is spread over its instants.
    """
    typed = (
        raw.select(
            "file_id",
            F.trim("mprn").alias("mprn"),
            F.lower("read_type").alias("kind"),
            to_number(F.col("read_value")).alias("value"),
            parse_read_time(F.col("read_time")).alias("datetime"),
        )
        .filter(F.col("datetime").isNotNull())
    )
    units = file_units(raw)
    scaled = localise(
        typed.join(units, "file_id", "left").withColumn(
            "value", F.when(F.col("is_kw"), F.col("value") / 2).otherwise(F.col("value"))
        )
    )
    is_import, is_export = F.col("kind").contains("import"), F.col("kind").contains("export")
    wide = scaled.groupBy("file_id", "mprn", "datetime", "datetime_utc").agg(
        F.sum(F.when(is_import, F.col("value"))).alias("import_kwh"),
        F.coalesce(F.sum(F.when(is_export, F.col("value"))), F.lit(0.0)).alias("export_kwh"),
        F.count_if(is_import).alias("import_reads"),
    )
    return wide.filter("import_reads > 0").drop("import_reads")


def one_file_per_instant(reads: DataFrame) -> DataFrame:
    """Reads of `file_reads` with overlapping files resolved: the first file by file_id wins a meter's instant.

    `repeats` counts the other files that hold the instant too.
    """
    first = F.min(F.struct("file_id", "import_kwh", "export_kwh"))
    merged = reads.groupBy("mprn", "datetime", "datetime_utc").agg(first.alias("r"), (F.count("*") - 1).alias("repeats"))
    return merged.select("r.file_id", "mprn", "datetime", "datetime_utc", "r.import_kwh", "r.export_kwh", "repeats")


def normalise_reads(raw: DataFrame) -> DataFrame:
    """Raw reads to one row per meter and instant, with features; files that overlap are not added up."""
    return with_features(one_file_per_instant(file_reads(raw)))


def with_features(df: DataFrame) -> DataFrame:
    """Hour, weekday, weekend flag, month, date and tariff period of every reading."""
    at = F.col("datetime")
    return (
        df.withColumn("hour", F.hour(at))
        .withColumn("date", at.cast("date"))
        .withColumn("day_of_week_num", F.weekday("date"))
        .withColumn("day_of_week", cal.day_name(F.col("date")))
        .withColumn("is_weekend", F.col("day_of_week_num") >= 5)
        .withColumn("month", cal.month_name(F.col("date")))
        .withColumn("year_month", cal.year_month(F.col("date")))
        .withColumn("tariff_period", cal.tariff_period(F.col("hour")))
    )


def with_gated_features(df: DataFrame, granularity: str = "granularity") -> DataFrame:
    """As `with_features`, but null where the series is too coarse for the feature."""
    daily = F.col(granularity).isin(C.DAILY_OR_FINER)
    interval = F.col(granularity).isin(C.INTERVAL_CODES)
    full = with_features(df)
    for name in ("day_of_week_num", "day_of_week", "is_weekend", "date"):
        full = full.withColumn(name, F.when(daily, F.col(name)))
    for name in ("hour", "tariff_period"):
        full = full.withColumn(name, F.when(interval, F.col(name)))
    return full


def file_reports(reads: DataFrame) -> DataFrame:
    """Parse report per meter file from `file_reads`: interval files count as half-hourly and complete."""
    return reads.groupBy("file_id").agg(
        F.count("*").alias("total_rows_raw"),
        F.count("*").alias("total_rows_clean"),
        F.lit(0).cast("bigint").alias("rows_dropped"),
        F.min("datetime").alias("date_range_start"),
        F.max("datetime").alias("date_range_end"),
        F.lit(C.HALF_HOURLY).alias("granularity"),
        F.lit(100.0).alias("completeness_pct"),
    )

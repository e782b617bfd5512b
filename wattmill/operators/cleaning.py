"""Mapped spreadsheet rows to clean readings, with the count of every repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.constants import FIELD_ORDER
from wattmill.functions.dates import with_dates
from wattmill.functions.numbers import clean_amount

UNKNOWN_MPRN = "Unknown"


def rename_columns(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pick the mapped cells of every row; files whose mapping has errors give no rows."""
    usable = mapping.filter(F.size("errors") == 0) if "errors" in mapping.columns else mapping
    picks = usable.select("file_id", *[f"{f}_idx" for f in FIELD_ORDER])
    return rows.join(picks, "file_id").select(
        "file_id", "row_idx",
        *[F.get("cells", F.col(f"{f}_idx")).alias(f) for f in FIELD_ORDER],
        F.col("export_kwh_idx").isNotNull().alias("has_export"),
        F.col("mprn_idx").isNotNull().alias("has_mprn"),
    )


def _blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def parse_rows(renamed: DataFrame) -> DataFrame:
    """Typed values and one flag per repair; no row is dropped here."""
    empty = _blank(F.col("datetime")) & _blank(F.col("import_kwh"))
    filled = F.when(~_blank(F.col("datetime")), F.col("datetime"))
    staged = renamed.withColumn("is_empty", empty).withColumn("text", filled)
    staged = with_dates(staged, {"day_first": "text"}, "day_first")
    # Month-first is only tried on what day-first rejected.
    staged = staged.withColumn("rest", F.when(F.col("day_first").isNull(), F.col("text")))
    staged = with_dates(staged, {"month_first": "rest"}, "month_first").withColumn(
        "at", F.coalesce("day_first", "month_first")
    )
    imported = clean_amount(F.col("import_kwh"))
    exported = clean_amount(F.col("export_kwh"))
    typed = staged.withColumn("raw_import", imported).withColumn("raw_export", exported)
    value, has_export = F.col("raw_import"), F.col("has_export")
    clipped = F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
    negative_part = F.when(value.isNotNull(), F.abs(F.least(value, F.lit(0.0))))
    return typed.select(
        "file_id", "row_idx", "is_empty", "has_export",
        F.col("at").alias("datetime"),
        (F.col("at").isNull() & F.col("text").isNotNull()).alias("date_failed"),
        (F.col("day_first").isNull() & F.col("at").isNotNull()).alias("date_swapped"),
        (F.col("at").isNotNull() & (value < 0)).alias("negative"),
        F.when(has_export, F.abs(value)).otherwise(clipped).alias("import_kwh"),
        F.when(has_export, F.col("raw_export")).otherwise(F.coalesce(negative_part, F.lit(0.0))).alias("export_kwh"),
        clean_amount(F.col("cost")).alias("cost"),
        F.when(F.col("has_mprn"), F.coalesce(F.trim("mprn"), F.lit(UNKNOWN_MPRN))).otherwise(UNKNOWN_MPRN)
        .alias("mprn"),
    )


def drop_duplicates(parsed: DataFrame) -> DataFrame:
    """First row per file, meter and timestamp, with the number of rows it stands for.

    Combined on the map side, so repeated copies of one timestamp never travel together.
    """
    kept = parsed.filter(~F.col("is_empty") & F.col("datetime").isNotNull())
    first = F.min_by(F.struct("import_kwh", "export_kwh", "cost"), "row_idx")
    return kept.groupBy("file_id", "mprn", "datetime").agg(first.alias("v"), F.count("*").alias("copies")).select(
        "file_id", "mprn", "datetime", "v.*", "copies"
    )


def override_mprn(clean: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace the meter of whole files: overrides(file_id, mprn_override); blank overrides do nothing."""
    new = F.trim("mprn_override")
    return (
        clean.join(overrides.select("file_id", "mprn_override"), "file_id", "left")
        .withColumn("mprn", F.when(new != "", new).otherwise(F.col("mprn")))
        .drop("mprn_override")
    )


def row_counts(parsed: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row per file: raw, clean and repaired rows."""
    raw = parsed.groupBy("file_id").agg(
        F.count("*").alias("rows_raw"),
        F.count_if("is_empty").alias("empty_rows"),
        F.count_if(~F.col("is_empty") & F.col("date_failed")).alias("date_parse"),
        F.count_if(~F.col("is_empty") & F.col("date_swapped")).alias("date_format_mixed"),
        F.count_if(~F.col("is_empty") & F.col("datetime").isNull()).alias("invalid_dates"),
        F.count_if("negative").alias("negative_values"),
        F.bool_or("has_export").alias("has_export"),
    )
    clean = deduped.groupBy("file_id").agg(
        F.count("*").alias("rows_clean"), F.sum(F.col("copies") - 1).alias("duplicates")
    )
    return raw.join(clean, "file_id", "left").fillna({"rows_clean": 0, "duplicates": 0})


def cleaning_issues(counts: DataFrame) -> DataFrame:
    """One issue row per kind of repair that happened."""
    def count(name: str) -> Column:
        return F.col(name).cast("string")

    specs = [
        ("empty_rows", "info", True, F.concat(F.lit("Empty rows removed: "), count("empty_rows"))),
        ("date_parse", "warning", False, F.concat(F.lit("Dates that could not be read: "), count("date_parse"))),
        ("date_format_mixed", "info", True,
         F.concat(F.lit("Dates read month first: "), count("date_format_mixed"))),
        ("invalid_dates", "warning", True,
         F.concat(F.lit("Rows dropped for lack of a date: "), count("invalid_dates"))),
        ("negative_values", "info", True,
         F.concat(F.lit("Negative imports "), F.when(F.col("has_export"), "made positive: ").otherwise(
             "moved to export: "), count("negative_values"))),
        ("duplicates", "info", True, F.concat(F.lit("Repeated timestamps removed: "), count("duplicates"))),
    ]
    issues = F.array(*[
        F.struct(
            F.lit(name).alias("category"), F.lit(severity).alias("severity"), message.alias("message"),
            F.col(name).cast("bigint").alias("affected_rows"), F.lit(fixed).alias("auto_fixed"),
        )
        for name, severity, fixed, message in specs
    ])
    return counts.select("file_id", F.inline(issues)).filter("affected_rows > 0")

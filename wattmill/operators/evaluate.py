"""Scoring extracted fields against known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.functions.dates import with_dates
from wattmill.functions.numbers import to_number
from wattmill.functions.steps import by_merge, staged

TOLERANCE, CRITICAL_WEIGHT, OTHER_WEIGHT, GATE = 0.02, 2.0, 1.0, 0.80


def values_match(expected: str, actual: str) -> Column:
    """Numbers within 0.02, else equal texts in any case, else equal dates.

    Expects the columns that `_with_parsed` adds.
    """
    e, a, ne, na = (F.col(f"_{n}_{part}") for part in ("plain", "number") for n in (expected, actual))
    return F.when(ne.isNotNull() & na.isNotNull(), F.abs(ne - na) <= TOLERANCE).otherwise(
        (e == a) | F.coalesce(F.col(f"_{expected}_date") == F.col(f"_{actual}_date"), F.lit(False))
    )


def _with_parsed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per name the plain text `_plain`, its `_number` and, unless all of them are numbers, its `_date`.

    Dates have one more layout, year-day-month, for strings the other layouts reject.
    """
    plain = df.withColumns({f"_{n}_plain": F.lower(F.replace(F.trim(F.col(n)), F.lit(","), F.lit(""))) for n in names})
    numbers = plain.withColumns({f"_{n}_number": to_number(F.col(f"_{n}_plain")) for n in names})
    settled = F.lit(True)
    for n in names:
        settled &= F.col(f"_{n}_number").isNotNull()
    texts = staged(numbers, {f"_{n}_text": F.when(~settled, F.col(n)) for n in names})
    dated = with_dates(texts, {f"_{n}_date": f"_{n}_text" for n in names})
    swapped = {n: F.regexp_replace(F.trim(F.col(f"_{n}_text")), r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$3-$2") for n in names}
    return dated.withColumns(
        {f"_{n}_date": F.coalesce(F.col(f"_{n}_date"), F.when(swapped[n].rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
                                                              swapped[n].try_cast("date"))) for n in names}
    )


def tier_fields(tier2: DataFrame, tier3: DataFrame, key: str = "filename") -> DataFrame:
    """Long field rows of two tiers, the first one given winning per field."""
    only3 = tier3.join(tier2.select(key, "field_name"), [key, "field_name"], "left_anti")
    return tier2.unionByName(only3)


def field_results(truth: DataFrame, fields: DataFrame, critical: Sequence[str]) -> DataFrame:
    """(filename, provider, field_name, expected, actual, critical, status, weight) for every applicable field.

    truth(filename, provider, expected MAP, not_applicable ARRAY); fields in long form with `filename`.
    """
    wanted = (
        truth.select("filename", "provider", "not_applicable", F.explode("expected").alias("field_name", "expected"))
        .filter(~F.array_contains("not_applicable", F.col("field_name")))
        .drop("not_applicable")
    )
    joined = wanted.join(
        by_merge(fields.select("filename", "field_name", F.col("value").alias("actual"))), ["filename", "field_name"], "left"
    )
    parsed = _with_parsed(joined, ["expected", "actual"])
    status = F.when(F.col("actual").isNull(), "MISS").when(values_match("expected", "actual"), "MATCH").otherwise("WRONG")
    is_critical = F.col("field_name").isin(list(critical))
    return parsed.select(
        "filename", "provider", "field_name", "expected", "actual", is_critical.alias("critical"), status.alias("status"),
        F.when(is_critical, CRITICAL_WEIGHT).otherwise(OTHER_WEIGHT).alias("weight"),
    )


def _accuracy() -> Column:
    return F.coalesce(F.try_divide(F.sum(F.when(F.col("status") == "MATCH", F.col("weight")).otherwise(0.0)),
                                   F.sum("weight")), F.lit(0.0))


def fixture_accuracy(results: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per fixture: weighted accuracy, counts, and whether the provider was recognised."""
    scored = results.groupBy("filename", "provider").agg(
        _accuracy().alias("accuracy"),
        F.count_if(F.col("status") == "MATCH").alias("fields_matched"),
        F.count_if(F.col("status") == "MISS").alias("fields_missing"),
    )
    return scored.join(by_merge(providers), "filename", "left").withColumn(
        "provider_match", F.coalesce(F.col("detected_provider") == F.col("provider"), F.lit(False))
    )


def aggregate_accuracy(truth: DataFrame, results: DataFrame, gate: float = GATE) -> DataFrame:
    """One row: accuracy over all fields, fixtures with and without results, and the gate."""
    done = results.groupBy("filename").agg(
        F.sum("weight").alias("weight"), F.sum(F.when(F.col("status") == "MATCH", F.col("weight")).otherwise(0.0)).alias("hit")
    )
    return truth.select("filename").join(by_merge(done), "filename", "left").agg(
        F.coalesce(F.try_divide(F.sum("hit"), F.sum("weight")), F.lit(0.0)).alias("aggregate_accuracy"),
        F.count("weight").alias("fixtures_evaluated"),
        F.count_if(F.col("weight").isNull()).alias("fixtures_skipped"),
    ).withColumn("passed", F.col("aggregate_accuracy") >= gate)

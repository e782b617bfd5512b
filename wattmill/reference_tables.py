"""Small fixed tables as DataFrames.  Their size never grows with the data, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattmill import constants as C


def tariff_presets(spark: SparkSession) -> DataFrame:
    """Preset rates in EUR/kWh per provider."""
    rows = [(p, d / 100, n / 100, k / 100) for p, d, n, k in C.TARIFF_PRESETS]
    return spark.createDataFrame(rows, "provider string, day_rate double, night_rate double, peak_rate double")


def fuel_factors(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(C.FUEL_FACTORS)]
    return spark.createDataFrame(
        rows,
        "position int, fuel_type string, display_name string, unit string, kwh_per_unit double, is_default boolean",
    )


def unit_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.UNIT_LABELS, "unit string, unit_label string")


def known_columns(spark: SparkSession) -> DataFrame:
    rows = [
        (field, synonym, priority)
        for field, names in C.KNOWN_COLUMNS.items()
        for priority, synonym in enumerate(names)
    ]
    return spark.createDataFrame(rows, "field string, synonym string, priority int")

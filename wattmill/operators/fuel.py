"""Solid and liquid fuels: conversion to kWh, lookups, and manual purchases as bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.reference_tables import fuel_factors, unit_labels


def convert_to_kwh(purchases: DataFrame) -> DataFrame:
    """Add `kwh`, or `error` for an unknown fuel or a unit the fuel is not sold in."""
    factors = fuel_factors(purchases.sparkSession)
    per_unit = factors.select("fuel_type", "unit", "kwh_per_unit")
    fuels = factors.groupBy("fuel_type").agg(
        F.first("display_name").alias("display_name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "unit"))), lambda u: u["unit"]), ", ")
        .alias("valid_units"),
    )
    joined = purchases.join(F.broadcast(per_unit), ["fuel_type", "unit"], "left").join(
        F.broadcast(fuels), "fuel_type", "left"
    )
    error = F.when(
        F.col("display_name").isNull(), F.concat(F.lit("Unknown fuel type: "), F.coalesce("fuel_type", F.lit("")))
    ).when(
        F.col("kwh_per_unit").isNull(),
        F.concat_ws("", F.lit("Invalid unit for "), "display_name", F.lit("; valid units: "), "valid_units"),
    )
    return (
        joined.withColumn("kwh", F.col("quantity") * F.col("kwh_per_unit"))
        .withColumn("error", error)
        .drop("kwh_per_unit", "valid_units")
    )


def fuel_units(spark: SparkSession) -> DataFrame:
    """(fuel_type, display_name, units in order, default_unit)."""
    return fuel_factors(spark).groupBy("fuel_type").agg(
        F.first("display_name").alias("display_name"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "unit"))), lambda u: u["unit"]).alias("units"),
        F.max(F.when(F.col("is_default"), F.col("unit"))).alias("default_unit"),
    )


def all_units(spark: SparkSession) -> DataFrame:
    """Distinct units in order of first use, with their labels."""
    first = fuel_factors(spark).groupBy("unit").agg(F.min("position").alias("position"))
    return first.join(F.broadcast(unit_labels(spark)), "unit", "left")


def purchases_to_bills(purchases: DataFrame) -> DataFrame:
    """Manual purchases to bill rows; invalid ones come back with `errors` and no amounts.

    Equal purchases share a hash; `first_purchases` keeps one of each.
    """
    converted = convert_to_kwh(purchases).join(F.broadcast(unit_labels(purchases.sparkSession)), "unit", "left")
    errors = F.filter(
        F.array(
            F.when(~(F.col("quantity") > 0), "Quantity must be greater than 0"),
            F.when(~(F.col("cost") > 0), "Total cost must be greater than 0"),
            F.col("error"),
        ),
        lambda e: e.isNotNull(),
    )
    key = F.md5(F.concat_ws(
        ":", F.lit("manual"), F.coalesce("fuel_type", F.lit("")), F.coalesce(F.col("purchase_date").cast("string"), F.lit("")),
        F.coalesce(F.col("cost").cast("string"), F.lit("")), F.coalesce(F.col("quantity").cast("string"), F.lit("")),
    ))
    valid = F.size("errors") == 0
    return converted.withColumn("errors", errors).select(
        "purchase_id", "errors", key.alias("content_hash"),
        F.coalesce(F.when(F.trim("supplier") != "", F.trim("supplier")), F.col("display_name")).alias("supplier"),
        "fuel_type",
        F.date_format("purchase_date", "dd MMM yyyy").alias("bill_date"),
        F.date_format("purchase_date", "dd/MM/yyyy").alias("billing_period_start"),
        F.date_format("period_end", "dd/MM/yyyy").alias("billing_period_end"),
        F.when(valid, F.round("kwh", 2)).alias("total_units_kwh"),
        F.when(valid, F.round("cost", 2)).alias("total_this_period"),
        F.lit("manual_entry").alias("extraction_method"),
        F.lit(1.0).alias("confidence_score"),
        F.format_string("%s - %.1f %s (%s)", "display_name", "quantity", F.coalesce("unit_label", "unit"),
                        F.date_format("purchase_date", "MMM yyyy")).alias("filename"),
        F.when(valid, "manual").otherwise("error").alias("status"),
    )


def first_purchases(bills: DataFrame) -> DataFrame:
    """Valid purchases without repeats, the lowest id of each hash; combined before the shuffle."""
    firsts = bills.filter("status = 'manual'").groupBy("content_hash").agg(F.min("purchase_id").alias("purchase_id"))
    return bills.join(firsts.select("purchase_id"), "purchase_id", "left_semi")

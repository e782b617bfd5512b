"""Load profiles and rollups per meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.functions.numbers import mean_of, ratio
from wattmill.operators.stats import INTERVALS_PER_HOUR

TARIFF_ORDER = ["Day", "Peak", "Night"]
NIGHT_HOURS = [23, 0, 1, 2, 3, 4, 5, 6]


def heatmap(readings: DataFrame) -> DataFrame:
    """Mean import per hour, one column per weekday."""
    return readings.groupBy("mprn", "hour").pivot("day_of_week", C.DAY_NAMES).agg(F.avg("import_kwh"))


def load_profile(readings: DataFrame) -> DataFrame:
    """Mean load (kW) per hour on weekdays and weekends."""
    weekend = F.col("is_weekend")
    return readings.groupBy("mprn", "hour").agg(
        (F.avg(F.when(~weekend, F.col("import_kwh"))) * INTERVALS_PER_HOUR).alias("weekday_kw"),
        (F.avg(F.when(weekend, F.col("import_kwh"))) * INTERVALS_PER_HOUR).alias("weekend_kw"),
    )


def tariff_breakdown(readings: DataFrame) -> DataFrame:
    """kWh and share per tariff period; all three periods appear for every meter."""
    total = F.sum("import_kwh")
    parts = [
        F.coalesce(F.sum(F.when(F.col("tariff_period") == p, F.col("import_kwh"))), F.lit(0.0)).alias(p)
        for p in TARIFF_ORDER
    ]
    wide = readings.groupBy("mprn").agg(total.alias("total"), *parts)
    rows = wide.select("mprn", "total", F.posexplode(F.array(*[
        F.struct(F.lit(p).alias("tariff_period"), F.col(p).alias("kwh")) for p in TARIFF_ORDER
    ])).alias("position", "row"))
    return rows.select(
        "mprn", "position", "row.tariff_period", "row.kwh",
        (ratio(F.col("row.kwh"), F.col("total")) * 100).alias("share_pct"),
    )


def hourly_import_export(readings: DataFrame) -> DataFrame:
    """Mean import and export per hour, in kWh per interval and in kW."""
    return readings.groupBy("mprn", "hour").agg(
        F.avg("import_kwh").alias("avg_import_kwh"),
        F.avg("export_kwh").alias("avg_export_kwh"),
        (F.avg("import_kwh") * INTERVALS_PER_HOUR).alias("avg_import_kw"),
        (F.avg("export_kwh") * INTERVALS_PER_HOUR).alias("avg_export_kw"),
    )


def daily_totals(readings: DataFrame) -> DataFrame:
    return readings.groupBy("mprn", "date").agg(
        F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh")
    )


def monthly_totals(readings: DataFrame) -> DataFrame:
    return readings.groupBy("mprn", "year_month").agg(
        F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh")
    )


def daily_trend(readings: DataFrame, last_n: int | None = 30) -> DataFrame:
    """Daily totals of the last `last_n` dates present, per meter."""
    days = daily_totals(readings)
    if last_n is None:
        return days
    recent = Window.partitionBy("mprn").orderBy(F.col("date").desc())
    return days.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= last_n).drop("rn")


def daily_baseload(readings: DataFrame) -> DataFrame:
    """Minimum and mean load (kW) per date, with the meter's mean of the minima."""
    days = readings.groupBy("mprn", "date").agg(
        (F.min("import_kwh") * INTERVALS_PER_HOUR).alias("baseload_kw"),
        (F.avg("import_kwh") * INTERVALS_PER_HOUR).alias("average_kw"),
    )
    return days.withColumn("mean_baseload_kw", F.avg("baseload_kw").over(Window.partitionBy("mprn")))


def heatmap_interpretation(readings: DataFrame) -> DataFrame:
    """Peak and quietest hour, night against day level with its band, weekday against weekend."""
    hourly = readings.groupBy("mprn", "hour").agg(
        F.avg("import_kwh").alias("kwh"),
        F.sum(F.when(F.col("is_weekend"), F.col("import_kwh"))).alias("we_sum"),
        F.count(F.when(F.col("is_weekend"), F.col("import_kwh"))).alias("we_n"),
        F.sum(F.when(~F.col("is_weekend"), F.col("import_kwh"))).alias("wd_sum"),
        F.count(F.when(~F.col("is_weekend"), F.col("import_kwh"))).alias("wd_n"),
    )
    at_night = F.col("hour").isin(NIGHT_HOURS)
    stats = hourly.groupBy("mprn").agg(
        F.max_by("hour", F.struct("kwh", (-F.col("hour")).alias("earlier"))).alias("peak_hour"),
        F.max("kwh").alias("peak_hour_kwh"),
        F.min_by("hour", F.struct("kwh", "hour")).alias("lowest_hour"),
        F.min("kwh").alias("lowest_hour_kwh"),
        F.avg(F.when(at_night, F.col("kwh"))).alias("night_avg_kwh"),
        F.avg(F.when(~at_night, F.col("kwh"))).alias("day_avg_kwh"),
        mean_of(F.sum("wd_sum"), F.sum("wd_n")).alias("weekday_avg_kwh"),
        mean_of(F.sum("we_sum"), F.sum("we_n")).alias("weekend_avg_kwh"),
    )
    night_pct = F.when(
        F.col("night_avg_kwh") > 0,
        F.when(F.col("day_avg_kwh") > 0, F.col("night_avg_kwh") / F.col("day_avg_kwh") * 100).otherwise(0.0),
    )
    pct, wd, we = F.col("night_pct"), F.col("weekday_avg_kwh"), F.col("weekend_avg_kwh")
    return (
        stats.withColumn("night_pct", night_pct)
        .withColumn("night_band", F.when(pct > 60, "high").when(pct > 30, "moderate").when(pct.isNotNull(), "low"))
        .withColumn("week_pattern", F.when(we > wd * 1.1, "weekend higher").when(wd > we * 1.1, "weekday higher"))
    )


def tariff_advice(summary: DataFrame) -> DataFrame:
    """Night and peak share of import and what to do about them."""
    night = ratio(F.col("tariff_night_kwh"), F.col("total_import_kwh")) * 100
    peak = ratio(F.col("tariff_peak_kwh"), F.col("total_import_kwh")) * 100
    return summary.select(
        "mprn",
        night.alias("night_pct"),
        peak.alias("peak_pct"),
        F.when(night < 30, "shift load to night").alias("night_advice"),
        F.when(peak > 15, "reduce peak load").alias("peak_advice"),
    )


def _gate(readings: DataFrame, codes: list[str]) -> DataFrame:
    return readings.filter(F.col("granularity").isin(codes))


def profiles_for(readings: DataFrame) -> dict[str, DataFrame]:
    """Every profile restricted to the series whose `granularity` supports it."""
    interval = _gate(readings, C.INTERVAL_CODES)
    return {
        "heatmap": heatmap(interval),
        "load_profile": load_profile(interval),
        "tariff_breakdown": tariff_breakdown(interval),
        "import_export_hourly": hourly_import_export(interval),
        "baseload_daily": daily_baseload(interval),
        "heatmap_interpretation": heatmap_interpretation(interval),
        "daily_trend": daily_trend(interval, 90).unionByName(daily_trend(_gate(readings, [C.DAILY]), None)),
        "monthly_trend": monthly_totals(readings),
    }

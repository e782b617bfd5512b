"""Summary statistics per meter, built on one shared daily rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.functions.calendar import epoch_seconds
from wattmill.functions.numbers import ratio

KEYS = ("mprn",)
INTERVALS_PER_HOUR = 2


def _sum_where(condition: Column, name: str, column: str = "import_kwh") -> Column:
    return F.sum(F.when(condition, F.col(column))).alias(name)


def daily_rollup(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per meter and date.  All buffers are fixed size, so this is a hash aggregate with
    map-side combine; everything per meter is computed from these few hundred rows a year.
    """
    tariff, hour = F.col("tariff_period"), F.col("hour")
    daytime = (hour >= 8) & (hour < 18)
    utc = F.col("datetime_utc") if "datetime_utc" in readings.columns else F.col("datetime")
    return (
        readings.groupBy(*keys, "date")
        .agg(
            F.sum("import_kwh").alias("import_kwh"),
            F.sum("export_kwh").alias("export_kwh"),
            F.min("import_kwh").alias("min_kwh"),
            F.max("import_kwh").alias("max_kwh"),
            F.count("import_kwh").alias("readings"),
            F.min(F.when(tariff == "Night", F.col("import_kwh"))).alias("night_min_kwh"),
            _sum_where(tariff == "Day", "day_kwh"),
            _sum_where(tariff == "Night", "night_kwh"),
            _sum_where(tariff == "Peak", "peak_kwh"),
            _sum_where(daytime, "daytime_import_kwh"),
            _sum_where(daytime, "daytime_export_kwh", "export_kwh"),
            _sum_where(hour == 22, "late_kwh"),
            F.count(F.when(hour == 22, F.col("import_kwh"))).alias("late_readings"),
            F.min("datetime").alias("first_at"),
            F.max("datetime").alias("last_at"),
            F.min(utc).alias("first_instant"),
            F.max(utc).alias("last_instant"),
        )
        .withColumn("is_weekend", F.weekday("date") >= 5)
        .withColumn("year_month", F.date_format("date", "yyyy-MM"))
    )


def whole_days(first: Column, last: Column) -> Column:
    """Elapsed whole days between two instants."""
    return F.floor((epoch_seconds(last) - epoch_seconds(first)) / 86400).cast("int")


def _zero(expr: Column) -> Column:
    return F.coalesce(expr, F.lit(0.0))


EXACT = "decimal(28,9)"


def exact_sum(*parts: Column) -> Column:
    """Sum of the first column less those of the others, in decimals, so that a figure on half a printed unit does not
    depend on the order of adding; in doubles where a value has no such decimal.
    """
    def less(sums: list[Column]) -> Column:
        return sum((-x for x in sums[1:]), sums[0])

    exact = less([F.coalesce(F.sum(p.try_cast(EXACT)), F.lit(0).cast(EXACT)) for p in parts]).cast("double")
    whole = F.bool_and(sum(((p.isNull() | p.try_cast(EXACT).isNotNull()).cast("int") for p in parts), F.lit(0)) == len(parts))
    return F.when(whole, exact).otherwise(less([_zero(F.sum(p)) for p in parts]))


def exact_avg(value: Column) -> Column:
    return F.try_divide(exact_sum(value), F.count(value))


def meter_totals() -> list[Column]:
    """Aggregates over daily rows that the summary and the anomaly rules share."""
    weekend = F.col("is_weekend")
    return [
        _zero(exact_sum(F.col("import_kwh"))).alias("total_import_kwh"),
        _zero(exact_sum(F.col("export_kwh"))).alias("total_export_kwh"),
        exact_avg(F.col("import_kwh")).alias("avg_daily_import_kwh"),
        _zero(F.avg("night_min_kwh") * INTERVALS_PER_HOUR).alias("baseload_kw"),
        (F.max("max_kwh") * INTERVALS_PER_HOUR).alias("peak_kw"),
        _zero(F.sum("day_kwh")).alias("tariff_day_kwh"),
        _zero(F.sum("night_kwh")).alias("tariff_night_kwh"),
        _zero(F.sum("peak_kwh")).alias("tariff_peak_kwh"),
        exact_avg(F.when(~weekend, F.col("import_kwh"))).alias("weekday_avg_kwh"),
        exact_avg(F.when(weekend, F.col("import_kwh"))).alias("weekend_avg_kwh"),
        F.min("first_at").alias("start_date"),
        F.max("last_at").alias("end_date"),
        whole_days(F.min("first_instant"), F.max("last_instant")).alias("date_range_days"),
    ]


def peak_times(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First instant of the highest reading."""
    rank = F.struct(F.col("import_kwh"), (-epoch_seconds(F.col("datetime"))).alias("earlier"))
    return readings.groupBy(*keys).agg(F.max_by("datetime", rank).alias("peak_time"))


def summary_stats(readings: DataFrame, keys: Sequence[str] = KEYS, with_peak_time: bool = True) -> DataFrame:
    """Totals, averages, baseload, peak, tariff split and range: one row per meter."""
    totals = (
        daily_rollup(readings, keys)
        .groupBy(*keys)
        .agg(*meter_totals(), exact_sum(F.col("import_kwh"), F.col("export_kwh")).alias("net_import_kwh"))
        .withColumn("has_solar", F.col("total_export_kwh") > 0)
    )
    return totals.join(peak_times(readings, keys), list(keys), "left") if with_peak_time else totals


def summary_stats_flexible(readings: DataFrame, granularity: str = "granularity") -> DataFrame:
    """Summary that degrades with the granularity column: no baseload, peak or tariff for coarse series."""
    keys = (*KEYS, granularity)
    full = summary_stats(readings, keys)
    interval = F.col(granularity).isin(C.INTERVAL_CODES)
    daily = F.col(granularity) == C.DAILY
    days = F.col("date_range_days")
    average = (
        F.when(interval | daily, F.col("avg_daily_import_kwh"))
        .when(days > 0, F.col("total_import_kwh") / days)
        .otherwise(F.col("total_import_kwh"))
    )
    out = full.withColumn("avg_daily_import_kwh", average)
    for name in ("baseload_kw", "peak_kw", "peak_time", "tariff_day_kwh", "tariff_night_kwh", "tariff_peak_kwh"):
        out = out.withColumn(name, F.when(interval, F.col(name)))
    for name in ("weekday_avg_kwh", "weekend_avg_kwh"):
        # A missing or zero average falls back to the daily average unless the series is interval data.
        usable = F.when(daily & (F.col(name) != 0), F.col(name))
        out = out.withColumn(name, F.when(interval, F.col(name)).otherwise(F.coalesce(usable, average)))
    return out


def weekend_change_pct(summary: DataFrame) -> DataFrame:
    """Weekend against weekday average in percent, null without a weekday average."""
    change = (ratio(F.col("weekend_avg_kwh"), F.col("weekday_avg_kwh")) - 1) * 100
    return summary.withColumn("weekend_vs_weekday_pct", change)

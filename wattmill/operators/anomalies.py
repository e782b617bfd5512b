"""Anomaly and insight rules: one metrics row per meter, every rule an expression over it.

The metrics come from the daily rollup (a few hundred rows per meter and year), so windows per meter
are bounded by the calendar however many raw reads a meter has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.functions.numbers import ratio
from wattmill.operators.stats import INTERVALS_PER_HOUR, KEYS, daily_rollup, meter_totals
from wattmill.operators.tariffs import always_on_cost_per_kw, blended_rate, with_rates

# Rule thresholds.
BASELOAD_KW, BASELOAD_ALERT_KW, PHANTOM_KW = 0.5, 1.0, 0.2
SPIKE_SIGMAS, SPIKE_DATES_SHOWN = 2, 5
STEP_MIN_DATES, STEP_WINDOW, STEP_MIN_ROWS, STEP_LAG, STEP_FLOOR_KW, STEP_CHANGE = 28, 14, 7, 7, 0.05, 0.25
RAMP_FACTOR, RAMP_HOUR, RAMP_DEFAULT_HOUR = 1.5, 5, 6
WEEKEND_FACTOR, WEEKEND_DAYS = 1.2, 104
PEAK_SHARE, PEAK_SHARE_WARNING, PEAK_EXPECTED = 0.12, 0.18, 2 / 24
TARIFF_LOSS_EUR, SELF_USE_FACTOR, BATTERY_CAPTURE = -10, 0.5, 0.6
SEASON_MIN_MONTHS, SEASON_DEVIATION = 3, 0.3

SEVERITY_ORDER = ["alert", "warning", "info"]


# ---------------------------------------------------------------- metrics


def _step_change(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest shift between the 14-row mean of daily minima and the same mean 7 rows earlier."""
    by_date = Window.partitionBy(*keys).orderBy("date")
    frame = by_date.rowsBetween(-(STEP_WINDOW - 1), 0)
    low = F.col("min_kwh") * INTERVALS_PER_HOUR
    rolled = days.withColumn(
        "after_kw", F.when(F.count("min_kwh").over(frame) >= STEP_MIN_ROWS, F.avg(low).over(frame))
    ).withColumn("before_kw", F.lag("after_kw", STEP_LAG).over(by_date))
    meaningful = (F.col("before_kw") > STEP_FLOOR_KW) & (F.col("after_kw") > STEP_FLOOR_KW)
    shift = F.when(meaningful, (F.col("after_kw") - F.col("before_kw")) / F.col("before_kw"))
    strong = F.when(F.abs(F.col("shift")) > STEP_CHANGE, F.abs(F.col("shift")))
    best = F.max_by(
        F.struct("date", "shift", "before_kw", "after_kw"),
        F.when(strong.isNotNull(), F.struct(strong.alias("size"), (-F.unix_date("date")).alias("earlier"))),
    )
    return (
        rolled.withColumn("shift", shift)
        .groupBy(*keys)
        .agg(best.alias("step"), F.count("*").alias("dates"))
        .select(*keys, F.when(F.col("dates") >= STEP_MIN_DATES, F.col("step")).alias("step"))
    )


def _seasonal(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Month furthest above the centred three-month mean."""
    months = days.groupBy(*keys, "year_month").agg(F.sum("import_kwh").alias("month_kwh"))
    centred = Window.partitionBy(*keys).orderBy("year_month").rowsBetween(-1, 1)
    trend = months.withColumn("trend_kwh", F.avg("month_kwh").over(centred)).withColumn(
        "deviation", ratio(F.col("month_kwh") - F.col("trend_kwh"), F.col("trend_kwh"))
    )
    odd = F.col("deviation") > SEASON_DEVIATION
    best = F.max_by(
        F.struct("year_month", "deviation", "month_kwh", "trend_kwh"),
        F.when(odd, F.struct("deviation", (-F.regexp_replace("year_month", "-", "").cast("int")).alias("earlier"))),
    )
    return (
        trend.groupBy(*keys)
        .agg(best.alias("season"), F.count("*").alias("months"))
        .select(*keys, F.when(F.col("months") >= SEASON_MIN_MONTHS, F.col("season")).alias("season"))
    )


def _weekday_hours(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weekday mean load per hour, as one array of (hour, kw) per meter: at most 24 entries."""
    hourly = (
        readings.filter(~F.col("is_weekend"))
        .groupBy(*keys, "hour")
        .agg((F.avg("import_kwh") * INTERVALS_PER_HOUR).alias("kw"))
    )
    return hourly.groupBy(*keys).agg(
        F.collect_list(F.struct("hour", "kw")).alias("weekday_hours"),
        F.max("kw").alias("weekday_max_kw"),
        F.max(F.when(F.col("hour") == RAMP_HOUR, F.col("kw"))).alias("early_kw"),
    )


def _with_spikes(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily rows with daily_mean, daily_std, threshold and is_spike."""
    per_meter = Window.partitionBy(*keys)
    return days.withColumns(
        {
            "daily_mean": F.avg("import_kwh").over(per_meter),
            "daily_std": F.coalesce(F.stddev_samp("import_kwh").over(per_meter), F.lit(0.0)),
        }
    ).withColumn("threshold", F.col("daily_mean") + SPIKE_SIGMAS * F.col("daily_std")).withColumn(
        "is_spike", (F.col("daily_std") > 0) & (F.col("import_kwh") > F.col("threshold")))


def spike_days(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, spike_date, threshold) of every spike day; a finding prints the first SPIKE_DATES_SHOWN of them."""
    return _with_spikes(daily_rollup(readings, keys), keys).filter("is_spike").select(
        *keys, F.col("date").alias("spike_date"), "threshold")


def meter_metrics(
    readings: DataFrame,
    tariffs: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    parts: Sequence[str] = ("step", "season", "hours"),
) -> DataFrame:
    """One row per meter with everything the rules need; `parts` leaves out what is not asked for."""
    days = daily_rollup(readings, keys)
    spread = _with_spikes(days, keys)
    is_spike = F.col("is_spike")
    metrics = spread.groupBy(*keys).agg(
        *meter_totals(),
        (F.min("min_kwh") * INTERVALS_PER_HOUR).alias("phantom_kw"),
        F.first("daily_mean").alias("daily_mean"),
        F.first("threshold").alias("spike_threshold"),
        F.count_if(is_spike).alias("spike_days"),
        F.sum(F.when(is_spike, F.col("import_kwh") - F.col("daily_mean"))).alias("spike_excess"),
        # One entry per spike date: bounded by the calendar.
        F.array_sort(F.collect_list(F.when(is_spike, F.col("date")))).alias("spike_dates"),
        F.sum("daytime_import_kwh").alias("daytime_import_kwh"),
        F.sum("daytime_export_kwh").alias("daytime_export_kwh"),
        (ratio(F.sum("late_kwh"), F.sum("late_readings")) * INTERVALS_PER_HOUR).alias("late_kw"),
    )
    metrics = metrics.withColumn("range_days", F.greatest(F.col("date_range_days"), F.lit(1)))
    extra = {"step": lambda: _step_change(days, keys), "season": lambda: _seasonal(days, keys),
             "hours": lambda: _weekday_hours(readings, keys)}
    for part in parts:
        metrics = metrics.join(extra[part](), list(keys), "left")
    return with_rates(metrics, tariffs)


# ---------------------------------------------------------------- rules


def _annual(amount: Column) -> Column:
    return amount / F.col("range_days") * 365


def _finding(
    kind: str,
    title: Column | str,
    severity: Column | str,
    category: Column | str | None,
    cost: Column | float | None,
    value: Column,
    dates: Column | None = None,
    **context: Column,
) -> Column:
    """Row of the anomaly table; `context` keeps the numbers a chart would mark."""
    def text(x: Column | str | None) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    entries = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in context.items()]
    notes = F.map_from_entries(F.array(*entries)) if entries else F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        text(title).alias("title"),
        text(severity).alias("severity"),
        text(category).alias("category"),
        (cost if isinstance(cost, Column) else F.lit(cost)).cast("double").alias("annual_cost_eur"),
        value.cast("double").alias("value"),
        notes.cast("map<string,string>").alias("context"),
        (F.lit(None) if dates is None else dates).cast("array<date>").alias("dates"),
    )


def _high_baseload() -> Column:
    kw = F.col("baseload_kw")
    return F.when(
        kw > BASELOAD_KW,
        _finding("high_baseload", "High Baseload", F.when(kw < BASELOAD_ALERT_KW, "warning").otherwise("alert"),
                 "anomaly", kw * always_on_cost_per_kw(), kw, threshold=F.lit(BASELOAD_KW)),
    )


def _phantom_load() -> Column:
    kw = F.col("phantom_kw")
    return F.when(
        kw > PHANTOM_KW,
        _finding("phantom_load", "Phantom Load", "warning", "anomaly", kw * always_on_cost_per_kw(), kw,
                 threshold=kw),
    )


def _spikes(costed: bool = True) -> Column:
    days = F.col("spike_days")
    return F.when(
        days > 0,
        _finding(
            "consumption_spikes", F.concat(days.cast("string"), F.lit(" Days with Unusual Spikes")), "info",
            "anomaly" if costed else None,
            _annual(F.col("spike_excess")) * blended_rate() if costed else None,
            days, F.slice("spike_dates", 1, SPIKE_DATES_SHOWN), threshold=F.col("spike_threshold"), daily_mean=F.col("daily_mean"),
        ),
    )


def _step() -> Column:
    step = F.col("step")
    delta = step["after_kw"] - step["before_kw"]
    up = delta > 0
    return F.when(
        step.isNotNull(),
        _finding(
            "baseload_step_change", "Baseload Step-Change", F.when(up, "warning").otherwise("info"),
            F.when(up, "anomaly").otherwise("insight"),
            F.when(up, F.abs(delta) * always_on_cost_per_kw()).otherwise(0.0),
            delta, F.array(step["date"]),
            before_kw=step["before_kw"], after_kw=step["after_kw"], change_pct=step["shift"] * 100,
        ),
    )


def _morning_ramp() -> Column:
    base, early = F.col("baseload_kw"), F.col("early_kw")
    spread = F.col("weekday_max_kw") - base
    started = F.filter("weekday_hours", lambda h: h["kw"] > base + 0.5 * spread)
    hour = F.coalesce(F.array_min(F.transform(started, lambda h: h["hour"])), F.lit(RAMP_DEFAULT_HOUR))
    return F.when(
        (base > 0) & (early > base * RAMP_FACTOR) & (spread > 0),
        _finding("morning_ramp", "Early Morning Ramp", "info", "anomaly",
                 (early - base) * F.col("day_rate") * 365, hour, from_hour=hour, to_hour=F.lit(8)),
    )


def _evening_tail() -> Column:
    base, late = F.col("baseload_kw"), F.col("late_kw")
    return F.when(
        (base > 0) & (late > base * RAMP_FACTOR),
        _finding("evening_tail", "Late Evening Tail", "info", "anomaly",
                 (late - base) * F.col("day_rate") * 365, late, from_hour=F.lit(19), to_hour=F.lit(23)),
    )


def _weekend(costed: bool = True) -> Column:
    wd, we = F.col("weekday_avg_kwh"), F.col("weekend_avg_kwh")
    return F.when(
        (wd > 0) & (we > wd * WEEKEND_FACTOR),
        _finding("high_weekend_usage", "Higher Weekend Usage", "info", "insight" if costed else None,
                 (we - wd) * WEEKEND_DAYS * blended_rate() if costed else None, ratio(we, wd),
                 weekday_avg_kwh=wd, weekend_avg_kwh=we),
    )


def _peak_overuse() -> Column:
    total = F.col("total_import_kwh")
    share = ratio(F.col("tariff_peak_kwh"), total)
    cost = (share - PEAK_EXPECTED) * _annual(total) * (F.col("peak_rate") - F.col("day_rate"))
    return F.when(
        (total > 0) & (share > PEAK_SHARE),
        _finding("peak_overuse", "Peak Period Overuse", F.when(share > PEAK_SHARE_WARNING, "warning").otherwise("info"),
                 "insight", cost, share),
    )


def _tariff_optimisation() -> Column:
    total = F.col("total_import_kwh")
    by_period = (
        F.col("tariff_night_kwh") * F.col("night_rate")
        + F.col("tariff_peak_kwh") * F.col("peak_rate")
        + F.col("tariff_day_kwh") * F.col("day_rate")
    )
    saving = _annual(total * F.col("day_rate")) - _annual(by_period)
    kind = "tariff_optimisation"
    return F.when(
        (total > 0) & (saving > 0), _finding(kind, "Smart Tariff Benefit", "info", "insight", 0.0, saving)
    ).when(
        (total > 0) & (saving < TARIFF_LOSS_EUR),
        _finding(kind, "Smart Tariff Disadvantage", "warning", "insight", -saving, saving),
    )


def _self_consumption() -> Column:
    exported = F.col("total_export_kwh")
    daytime = F.col("daytime_export_kwh")
    stored = exported / F.col("range_days") * BATTERY_CAPTURE
    return F.when(
        (exported > 0) & (daytime > F.coalesce(F.col("daytime_import_kwh"), F.lit(0.0)) * SELF_USE_FACTOR),
        _finding("low_self_consumption", "Consider Battery Storage", "info", "insight",
                 stored * F.col("day_rate") * 365, daytime,
                 annual_export_kwh=_annual(exported), export_credit_eur=_annual(exported) * C.EXPORT_RATE_EUR,
                 battery_kwh_per_day=stored),
    )


def _seasonal_variation() -> Column:
    season = F.col("season")
    return F.when(
        season.isNotNull(),
        _finding("seasonal_variation", "Seasonal Anomaly", "info", "insight",
                 (season["month_kwh"] - season["trend_kwh"]) * blended_rate(), season["deviation"] * 100,
                 month=season["year_month"], month_kwh=season["month_kwh"]),
    )


def _monthly_outliers() -> Column:
    months = F.col("spike_days")
    return F.when(
        months > 0,
        _finding("monthly_outliers", F.concat(months.cast("string"), F.lit(" Months with Unusual Consumption")),
                 "info", None, None, months),
    )


@dataclass(frozen=True)
class Rule:
    expression: Callable[[], Column]
    parts: tuple[str, ...] = ()


# In emission order.
RULES: dict[str, Rule] = {
    "high_baseload": Rule(_high_baseload),
    "phantom_load": Rule(_phantom_load),
    "consumption_spikes": Rule(_spikes),
    "baseload_step_change": Rule(_step, ("step",)),
    "morning_ramp": Rule(_morning_ramp, ("hours",)),
    "evening_tail": Rule(_evening_tail),
    "high_weekend_usage": Rule(_weekend),
    "peak_overuse": Rule(_peak_overuse),
    "tariff_optimisation": Rule(_tariff_optimisation),
    "low_self_consumption": Rule(_self_consumption),
    "seasonal_variation": Rule(_seasonal_variation, ("season",)),
}


def _emit(metrics: DataFrame, keys: Sequence[str], findings: list[Column]) -> DataFrame:
    rows = metrics.select(*keys, F.posexplode(F.array(*findings)).alias("rule_no", "finding"))
    return rows.filter(F.col("finding").isNotNull()).select(*keys, "rule_no", "finding.*")


def detect_anomalies(
    readings: DataFrame, tariffs: DataFrame | None = None, rules: Sequence[str] | None = None
) -> DataFrame:
    """Findings of the interval rules (all, or those named), one row each."""
    chosen = list(rules or RULES)
    parts = [p for name in chosen for p in RULES[name].parts]
    metrics = meter_metrics(readings, tariffs, parts=parts)
    return _emit(metrics, KEYS, [RULES[name].expression() for name in chosen])


def detect_anomalies_flexible(
    readings: DataFrame, tariffs: DataFrame | None = None, granularity: str = "granularity"
) -> DataFrame:
    """Rules by granularity: all for interval series, weekend and spikes for daily, outliers for monthly."""
    keys = (*KEYS, granularity)
    metrics = meter_metrics(readings, tariffs, keys=keys)
    code = F.col(granularity)
    findings = [F.when(code.isin(C.INTERVAL_CODES), rule.expression()) for rule in RULES.values()]
    findings += [
        F.when(code == C.DAILY, _weekend(costed=False)),
        F.when(code == C.DAILY, _spikes(costed=False)),
        F.when(code == C.MONTHLY, _monthly_outliers()),
    ]
    return _emit(metrics, keys, findings)


# ---------------------------------------------------------------- rollups


def anomaly_rollup(anomalies: DataFrame) -> DataFrame:
    """Waste, savings potential and counts by severity per meter."""
    cost = F.coalesce(F.col("annual_cost_eur"), F.lit(0.0))
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITY_ORDER]
    return anomalies.groupBy("mprn").agg(
        F.coalesce(F.sum(F.when(F.col("category") == "anomaly", cost)), F.lit(0.0)).alias("annual_waste_eur"),
        F.coalesce(F.sum(F.when(F.col("category") == "insight", cost)), F.lit(0.0)).alias("annual_savings_eur"),
        F.count("*").alias("findings"),
        *counts,
    )


def by_severity(anomalies: DataFrame) -> DataFrame:
    """Number the findings of each meter (at most one per rule): alerts first, then rule order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    order = Window.partitionBy("mprn").orderBy(rank, "rule_no")
    return anomalies.withColumn("position", F.row_number().over(order))


def top_alerts(anomalies: DataFrame, n: int = 3) -> DataFrame:
    """The first `n` problems worth attention, in the order the rules report them."""
    serious = anomalies.filter((F.col("category") == "anomaly") & F.col("severity").isin("warning", "alert"))
    order = Window.partitionBy("mprn").orderBy("rule_no")
    return serious.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)

"""Granularity, gaps, spikes, constancy and completeness of time series, and the quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.functions.calendar import epoch_seconds

# Upper bounds of the median gap in minutes, expected gaps, and check limits.
GRANULARITY_LIMITS = [(35, C.HALF_HOURLY), (65, C.HOURLY), (1500, C.DAILY), (45000, C.MONTHLY)]
EXPECTED_GAP_MINUTES = {C.HALF_HOURLY: 30, C.HOURLY: 60, C.DAILY: 1440}
GAP_FACTOR, SPIKE_SIGMAS, CONSTANT_MIN_ROWS, CONSTANT_MAX_VALUES = 1.5, 5, 10, 3
COMPLETE_PCT, HALF_COMPLETE_PCT = 90, 50
KEYS = ("mprn",)


def time_steps(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, gap_start, gap_end, gap_seconds) between neighbouring timestamps.

    Steps inside a date come from a window per series and date; the step over midnight comes from the first
    and last timestamp of each date.  No task sees more than one date of readings, or one row per date.
    """
    dated = series.select(*keys, "datetime", F.col("datetime").cast("date").alias("on_date"))
    inside = dated.withColumn(
        "gap_start", F.lag("datetime").over(Window.partitionBy(*keys, "on_date").orderBy("datetime"))
    ).select(*keys, "gap_start", F.col("datetime").alias("gap_end"))
    edges = dated.groupBy(*keys, "on_date").agg(F.min("datetime").alias("gap_end"), F.max("datetime").alias("last_at"))
    across = edges.withColumn(
        "gap_start", F.lag("last_at").over(Window.partitionBy(*keys).orderBy("on_date"))
    ).select(*keys, "gap_start", "gap_end")
    return (
        inside.unionByName(across)
        .filter(F.col("gap_start").isNotNull())
        .withColumn("gap_seconds", epoch_seconds(F.col("gap_end")) - epoch_seconds(F.col("gap_start")))
    )


def granularity_of(minutes: Column) -> Column:
    code = F.lit(C.UNKNOWN)
    for limit, name in reversed(GRANULARITY_LIMITS):
        code = F.when(minutes <= limit, name).otherwise(code)
    return F.coalesce(code, F.lit(C.UNKNOWN))


def detect_granularity(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class of the median step per series; series of one row are unknown.

    The median is taken from counts per distinct step, so equal steps are merged before the shuffle.
    """
    histogram = time_steps(series, keys).groupBy(*keys, "gap_seconds").agg(F.count("*").alias("n"))
    medians = histogram.groupBy(*keys).agg(
        (F.percentile("gap_seconds", F.lit(0.5), F.col("n")) / 60).alias("median_minutes")
    )
    every = series.select(*keys).distinct()
    return every.join(medians, list(keys), "left").withColumn(
        "granularity", F.when(F.col("median_minutes").isNull(), C.UNKNOWN).otherwise(
            granularity_of(F.col("median_minutes")))
    )


def _expected_step(code: Column) -> Column:
    seconds = F.lit(None).cast("double")
    for name, minutes in EXPECTED_GAP_MINUTES.items():
        seconds = F.when(code == name, float(minutes * 60)).otherwise(seconds)
    return seconds


def find_gaps(series: DataFrame, granularity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every step longer than 1.5 times the expected one."""
    coded = time_steps(series, keys).join(granularity.select(*keys, "granularity"), list(keys))
    return coded.filter(F.col("gap_seconds") > _expected_step(F.col("granularity")) * GAP_FACTOR)


def gap_summary(gaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count("*").alias("gaps"), F.max("gap_seconds").alias("largest_gap_seconds"))


def find_spikes(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings above mean + 5 standard deviations; the two moments are a small table joined back."""
    moments = series.groupBy(*keys).agg(F.avg("import_kwh").alias("mean"), F.stddev_samp("import_kwh").alias("std"))
    return series.join(moments, list(keys)).filter(
        (F.col("std") > 0) & (F.col("import_kwh") > F.col("mean") + SPIKE_SIGMAS * F.col("std"))
    )


def constant_series(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series of more than ten rows with at most three distinct values."""
    values = series.groupBy(*keys, "import_kwh").agg(F.count("*").alias("n"))
    counts = values.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count("import_kwh").alias("distinct_values")
    )
    return counts.filter((F.col("rows") > CONSTANT_MIN_ROWS) & (F.col("distinct_values") <= CONSTANT_MAX_VALUES))


def _span(first: Column, last: Column) -> tuple[Column, Column]:
    seconds = epoch_seconds(last) - epoch_seconds(first)
    return seconds, F.floor(seconds / 86400)


def completeness(series: DataFrame, granularity: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows against the rows expected for the span, once for the check and once, capped, for the report."""
    extent = series.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at")
    ).join(granularity.select(*keys, "granularity"), list(keys))
    seconds, days = _span(F.col("first_at"), F.col("last_at"))
    code, rows = F.col("granularity"), F.col("rows")
    interval = F.when(code == C.HALF_HOURLY, seconds / 1800).when(code == C.HOURLY, seconds / 3600)
    for_check = F.coalesce(interval, F.when(code == C.DAILY, days + 1.0).when(code == C.MONTHLY, days / 30))
    for_report = F.coalesce(
        interval, F.when(code == C.DAILY, days + 1.0).when(code == C.MONTHLY, F.greatest(days / 30, F.lit(1.0))),
        rows.cast("double"),
    )
    pct = F.when((for_check > 0) & (rows >= 2), rows / for_check * 100)
    return extent.select(
        *keys, "rows", "first_at", "last_at", "granularity",
        for_check.alias("expected_rows"),
        pct.alias("check_pct"),
        F.when(pct < COMPLETE_PCT, F.when(pct > HALF_COMPLETE_PCT, "warning").otherwise("error")).alias(
            "completeness_severity"),
        F.coalesce(F.when(for_report > 0, F.least(rows / for_report * 100, F.lit(100.0))), F.lit(0.0)).alias(
            "completeness_pct"),
    )


def series_checks(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All checks, one row per series."""
    on = list(keys)
    codes = detect_granularity(series, keys)
    spikes = find_spikes(series, keys).groupBy(*keys).agg(F.count("*").alias("spikes"))
    constant = constant_series(series, keys).select(*keys, "distinct_values")
    return (
        completeness(series, codes, keys)
        .join(gap_summary(find_gaps(series, codes, keys), keys), on, "left")
        .join(spikes, on, "left")
        .join(constant, on, "left")
        .fillna({"gaps": 0, "spikes": 0})
    )


def series_issues(checks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One issue row per failed check."""
    def issue(when: Column, category: str, severity: Column | str, message: Column, rows: Column) -> Column:
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(when, F.struct(
            F.lit(category).alias("category"), level.alias("severity"), message.alias("message"),
            rows.cast("bigint").alias("affected_rows"), F.lit(False).alias("auto_fixed"),
        ))

    found = F.array(
        issue(F.col("gaps") > 0, "gaps", "warning",
              F.concat(F.lit("Gaps in the series: "), F.col("gaps").cast("string")), F.col("gaps")),
        issue(F.col("spikes") > 0, "spikes", "info",
              F.concat(F.lit("Readings far above the mean: "), F.col("spikes").cast("string")), F.col("spikes")),
        issue(F.col("distinct_values").isNotNull(), "constant_data", "warning",
              F.concat(F.lit("Distinct values found: "), F.col("distinct_values").cast("string")), F.col("rows")),
        issue(F.col("completeness_severity").isNotNull(), "completeness", F.col("completeness_severity"),
              F.concat(F.lit("Completeness in percent: "), F.format_string("%.0f", "check_pct")),
              F.col("expected_rows") - F.col("rows")),
    )
    return checks.select(*keys, F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select(*keys, "i.*")


def quality_report(counts: DataFrame, checks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per file: row counts, range, granularity of its largest series, issues and usability.

    `counts` has one row per file, `checks` one per (file_id, mprn), `issues` a handful per file.
    """
    main = F.max_by(
        F.struct("granularity", "completeness_pct"), F.struct("rows", "mprn")
    )
    series = checks.groupBy("file_id").agg(
        F.min("first_at").alias("date_range_start"), F.max("last_at").alias("date_range_end"), main.alias("main")
    )
    # Issues per file are few: at most one of each category per meter of the file.
    levels = issues.groupBy("file_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count("*").alias("issue_count"),
    )
    joined = counts.join(series, "file_id", "left").join(levels, "file_id", "left").fillna(
        {"error_count": 0, "warning_count": 0, "issue_count": 0}
    )
    return joined.select(
        "file_id",
        F.col("rows_raw").alias("total_rows_raw"),
        F.col("rows_clean").alias("total_rows_clean"),
        (F.col("rows_raw") - F.col("rows_clean")).alias("rows_dropped"),
        "date_range_start", "date_range_end",
        F.coalesce("main.granularity", F.lit(C.UNKNOWN)).alias("granularity"),
        F.coalesce("main.completeness_pct", F.lit(0.0)).alias("completeness_pct"),
        "error_count", "warning_count", "issue_count",
        ((F.col("error_count") == 0) & (F.col("rows_clean") > 0)).alias("is_usable"),
    )

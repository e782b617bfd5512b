"""Summary, profile, anomaly and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.operators import anomalies as an
from wattmill.operators import filters, profiles, stats, tariffs
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import DAILY_READINGS_SQL, READINGS_SQL, daily_readings, readings

DAILY_SQL = """
daily AS (
  SELECT mprn, date, any_value(is_weekend) AS is_weekend, any_value(year_month) AS year_month,
         sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh, min(import_kwh) AS min_kwh,
         max(import_kwh) AS max_kwh,
         min(import_kwh) FILTER (WHERE tariff_period = 'Night') AS night_min_kwh,
         sum(import_kwh) FILTER (WHERE tariff_period = 'Day') AS day_kwh,
         sum(import_kwh) FILTER (WHERE tariff_period = 'Night') AS night_kwh,
         sum(import_kwh) FILTER (WHERE tariff_period = 'Peak') AS peak_kwh,
         sum(import_kwh) FILTER (WHERE hour BETWEEN 8 AND 17) AS daytime_import_kwh,
         sum(export_kwh) FILTER (WHERE hour BETWEEN 8 AND 17) AS daytime_export_kwh,
         min(datetime) AS first_at, max(datetime) AS last_at
  FROM readings GROUP BY mprn, date)"""

TOTALS_SQL = """
totals AS (
  SELECT mprn, sum(import_kwh) AS total_import_kwh, sum(export_kwh) AS total_export_kwh,
         avg(import_kwh) AS avg_daily_import_kwh, coalesce(avg(night_min_kwh) * 2, 0.0) AS baseload_kw,
         max(max_kwh) * 2 AS peak_kw, coalesce(sum(day_kwh), 0.0) AS tariff_day_kwh,
         coalesce(sum(night_kwh), 0.0) AS tariff_night_kwh, coalesce(sum(peak_kwh), 0.0) AS tariff_peak_kwh,
         avg(import_kwh) FILTER (WHERE NOT is_weekend) AS weekday_avg_kwh,
         avg(import_kwh) FILTER (WHERE is_weekend) AS weekend_avg_kwh,
         min(first_at) AS start_date, max(last_at) AS end_date,
         CAST(floor(epoch(max(last_at) - min(first_at)) / 86400) AS INTEGER) AS date_range_days
  FROM daily GROUP BY mprn),
m AS (
  SELECT *, greatest(date_range_days, 1) AS range_days, 0.2814 AS day_rate, 0.1479 AS night_rate, 0.3002 AS peak_rate,
         3285 * 0.1479 + 730 * 0.3002 + 4745 * 0.2814 AS per_kw,
         9 / 24 * 0.1479 + 2 / 24 * 0.3002 + 13 / 24 * 0.2814 AS blended
  FROM totals)"""

METER_SQL = f"{READINGS_SQL},{DAILY_SQL},{TOTALS_SQL}"

SUMMARY_DOUBLES = (
    "total_import_kwh, total_export_kwh, avg_daily_import_kwh, baseload_kw, peak_kw, tariff_day_kwh, "
    "tariff_night_kwh, tariff_peak_kwh, weekday_avg_kwh, weekend_avg_kwh, net_import_kwh"
)
SUMMARY_SQL = """
SELECT t.*, total_import_kwh - total_export_kwh AS net_import_kwh, total_export_kwh > 0 AS has_solar, p.peak_time
FROM totals t JOIN (
  SELECT mprn, min(datetime) AS peak_time FROM (
    SELECT mprn, datetime, import_kwh, max(import_kwh) OVER (PARTITION BY mprn) AS top FROM readings)
  WHERE import_kwh = top GROUP BY mprn) p USING (mprn)"""


@query("summary_stats", rounded_sql(SUMMARY_SQL, SUMMARY_DOUBLES, METER_SQL))
def summary_stats(spark, sf):
    return stats.summary_stats(readings(spark, sf))


FLEX_CODES_SQL = """
coded AS (SELECT *, CASE CAST(substr(mprn, 11, 1) AS INTEGER) % 3
                    WHEN 0 THEN '30min' WHEN 1 THEN 'daily' ELSE 'monthly' END AS granularity FROM totals)"""


def with_code(df):
    """Treat the meters as three kinds of series by their last digit."""
    digit = F.substring("mprn", 11, 1).cast("int") % 3
    return df.withColumn("granularity", F.when(digit == 0, "30min").when(digit == 1, "daily").otherwise("monthly"))


@query(
    "summary_flexible",
    rounded_sql(
        """
SELECT mprn, granularity, total_import_kwh, total_export_kwh, date_range_days, a AS avg_daily_import_kwh,
       CASE WHEN granularity = '30min' THEN baseload_kw END AS baseload_kw,
       CASE WHEN granularity = '30min' THEN tariff_day_kwh END AS tariff_day_kwh,
       CASE WHEN granularity = '30min' THEN weekday_avg_kwh
            WHEN granularity = 'daily' THEN coalesce(nullif(weekday_avg_kwh, 0), a) ELSE a END AS weekday_avg_kwh
FROM (SELECT *, CASE WHEN granularity <> 'monthly' THEN avg_daily_import_kwh
                     WHEN date_range_days > 0 THEN total_import_kwh / date_range_days
                     ELSE total_import_kwh END AS a FROM coded)""",
        "total_import_kwh, total_export_kwh, avg_daily_import_kwh, baseload_kw, tariff_day_kwh, weekday_avg_kwh",
        f"{METER_SQL},{FLEX_CODES_SQL}",
    ),
)
def summary_flexible(spark, sf):
    return stats.summary_stats_flexible(with_code(readings(spark, sf))).select(
        "mprn", "granularity", "total_import_kwh", "total_export_kwh", "date_range_days", "avg_daily_import_kwh",
        "baseload_kw", "tariff_day_kwh", "weekday_avg_kwh",
    )


@query(
    "weekend_change",
    rounded_sql(
        "SELECT mprn, (weekend_avg_kwh / weekday_avg_kwh - 1) * 100 AS weekend_vs_weekday_pct FROM totals",
        "weekend_vs_weekday_pct", METER_SQL,
    ),
)
def weekend_change(spark, sf):
    summary = stats.summary_stats(readings(spark, sf), with_peak_time=False)
    return stats.weekend_change_pct(summary).select("mprn", "weekend_vs_weekday_pct")


@query(
    "reading_features",
    rounded_sql(
        """SELECT mprn, datetime, import_kwh, export_kwh, hour::INTEGER AS hour, date,
           day_of_week_num::INTEGER AS day_of_week_num, day_of_week, is_weekend, month, year_month, tariff_period
           FROM readings""",
        "import_kwh, export_kwh", READINGS_SQL,
    ),
)
def reading_features(spark, sf):
    return readings(spark, sf)


# ---------------------------------------------------------------- profiles

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query(
    "heatmap",
    rounded_sql(
        "SELECT mprn, hour::INTEGER AS hour, "
        + ", ".join(f"avg(import_kwh) FILTER (WHERE day_of_week = '{d}') AS \"{d}\"" for d in DAYS)
        + " FROM readings GROUP BY mprn, hour",
        ", ".join(DAYS), READINGS_SQL,
    ),
)
def heatmap(spark, sf):
    return profiles.heatmap(readings(spark, sf))


@query(
    "load_profile",
    rounded_sql(
        """SELECT mprn, hour::INTEGER AS hour, avg(import_kwh) FILTER (WHERE NOT is_weekend) * 2 AS weekday_kw,
           avg(import_kwh) FILTER (WHERE is_weekend) * 2 AS weekend_kw FROM readings GROUP BY mprn, hour""",
        "weekday_kw, weekend_kw", READINGS_SQL,
    ),
)
def load_profile(spark, sf):
    return profiles.load_profile(readings(spark, sf))


@query(
    "tariff_breakdown",
    rounded_sql(
        """SELECT mprn, p.position::INTEGER AS position, p.tariff_period,
           coalesce(sum(import_kwh) FILTER (WHERE r.tariff_period = p.tariff_period), 0.0) AS kwh,
           coalesce(sum(import_kwh) FILTER (WHERE r.tariff_period = p.tariff_period), 0.0)
             / nullif(sum(import_kwh), 0) * 100 AS share_pct
           FROM readings r, (VALUES (0, 'Day'), (1, 'Peak'), (2, 'Night')) p(position, tariff_period)
           GROUP BY mprn, p.position, p.tariff_period""",
        "kwh, share_pct", READINGS_SQL,
    ),
)
def tariff_breakdown(spark, sf):
    return profiles.tariff_breakdown(readings(spark, sf))


@query(
    "monthly_trend",
    rounded_sql(
        """SELECT mprn, year_month, sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh
           FROM readings GROUP BY mprn, year_month""",
        "import_kwh, export_kwh", DAILY_READINGS_SQL,
    ),
)
def monthly_trend(spark, sf):
    return profiles.monthly_totals(daily_readings(spark, sf))


@query(
    "daily_trend_last_n",
    rounded_sql(
        """SELECT mprn, date, import_kwh, export_kwh FROM daily
           QUALIFY row_number() OVER (PARTITION BY mprn ORDER BY date DESC) <= 14""",
        "import_kwh, export_kwh", f"{READINGS_SQL},{DAILY_SQL}",
    ),
)
def daily_trend_last_n(spark, sf):
    return profiles.daily_trend(readings(spark, sf), 14)


@query(
    "import_export_hourly",
    rounded_sql(
        """SELECT mprn, hour::INTEGER AS hour, avg(import_kwh) AS avg_import_kwh, avg(export_kwh) AS avg_export_kwh,
           avg(import_kwh) * 2 AS avg_import_kw, avg(export_kwh) * 2 AS avg_export_kw FROM readings GROUP BY mprn, hour""",
        "avg_import_kwh, avg_export_kwh, avg_import_kw, avg_export_kw", READINGS_SQL,
    ),
)
def import_export_hourly(spark, sf):
    return profiles.hourly_import_export(readings(spark, sf))


@query(
    "baseload_daily",
    rounded_sql(
        """SELECT *, avg(baseload_kw) OVER (PARTITION BY mprn) AS mean_baseload_kw FROM (
             SELECT mprn, date, min(import_kwh) * 2 AS baseload_kw, avg(import_kwh) * 2 AS average_kw
             FROM readings GROUP BY mprn, date)""",
        "baseload_kw, average_kw, mean_baseload_kw", READINGS_SQL,
    ),
)
def baseload_daily(spark, sf):
    return profiles.daily_baseload(readings(spark, sf))


@query(
    "heatmap_interpretation",
    rounded_sql(
        """
SELECT mprn, peak_hour, peak_hour_kwh, lowest_hour, lowest_hour_kwh, night_avg_kwh, day_avg_kwh, weekday_avg_kwh,
       weekend_avg_kwh, night_pct,
       CASE WHEN night_pct > 60 THEN 'high' WHEN night_pct > 30 THEN 'moderate'
            WHEN night_pct IS NOT NULL THEN 'low' END AS night_band,
       CASE WHEN weekend_avg_kwh > weekday_avg_kwh * 1.1 THEN 'weekend higher'
            WHEN weekday_avg_kwh > weekend_avg_kwh * 1.1 THEN 'weekday higher' END AS week_pattern
FROM (
  SELECT h.*, w.weekday_avg_kwh, w.weekend_avg_kwh,
         CASE WHEN night_avg_kwh > 0 THEN CASE WHEN day_avg_kwh > 0 THEN night_avg_kwh / day_avg_kwh * 100
              ELSE 0.0 END END AS night_pct
  FROM (
    SELECT mprn, max(kwh) AS peak_hour_kwh, min(kwh) AS lowest_hour_kwh,
           (array_agg(hour ORDER BY kwh DESC, hour))[1]::INTEGER AS peak_hour,
           (array_agg(hour ORDER BY kwh, hour))[1]::INTEGER AS lowest_hour,
           avg(kwh) FILTER (WHERE hour = 23 OR hour < 7) AS night_avg_kwh,
           avg(kwh) FILTER (WHERE hour BETWEEN 7 AND 22) AS day_avg_kwh
    FROM (SELECT mprn, hour, avg(import_kwh) AS kwh FROM readings GROUP BY mprn, hour) GROUP BY mprn) h
  JOIN (SELECT mprn, avg(import_kwh) FILTER (WHERE NOT is_weekend) AS weekday_avg_kwh,
               avg(import_kwh) FILTER (WHERE is_weekend) AS weekend_avg_kwh
        FROM readings GROUP BY mprn) w USING (mprn))""",
        "peak_hour_kwh, lowest_hour_kwh, night_avg_kwh, day_avg_kwh, weekday_avg_kwh, weekend_avg_kwh, night_pct",
        READINGS_SQL,
    ),
)
def heatmap_interpretation(spark, sf):
    return profiles.heatmap_interpretation(readings(spark, sf))


@query(
    "tariff_advice",
    rounded_sql(
        """SELECT mprn, night_pct, peak_pct, CASE WHEN night_pct < 30 THEN 'shift load to night' END AS night_advice,
           CASE WHEN peak_pct > 15 THEN 'reduce peak load' END AS peak_advice
           FROM (SELECT mprn, tariff_night_kwh / total_import_kwh * 100 AS night_pct,
                        tariff_peak_kwh / total_import_kwh * 100 AS peak_pct FROM totals)""",
        "night_pct, peak_pct", METER_SQL,
    ),
)
def tariff_advice(spark, sf):
    return profiles.tariff_advice(stats.summary_stats(readings(spark, sf), with_peak_time=False))


# ---------------------------------------------------------------- anomaly rules

FINDING = "mprn, type, title, severity, category, annual_cost_eur, value"


def _finding_sql(kind: str, title: str, severity: str, category: str, cost: str, value: str, source: str) -> str:
    return (
        f"SELECT mprn, '{kind}' AS type, {title} AS title, {severity} AS severity, {category} AS category, "
        f"({cost})::DOUBLE AS annual_cost_eur, ({value})::DOUBLE AS value FROM {source}"
    )


SPIKES_CTE = """
spikes AS (
  SELECT mprn, count(*) AS spike_days, sum(import_kwh - daily_mean) AS excess,
         list_slice(list_sort(list(date)), 1, 5) AS dates, any_value(threshold) AS threshold
  FROM (SELECT *, avg(import_kwh) OVER w AS daily_mean, stddev_samp(import_kwh) OVER w AS sd,
               avg(import_kwh) OVER w + 2 * stddev_samp(import_kwh) OVER w AS threshold
        FROM daily WINDOW w AS (PARTITION BY mprn))
  WHERE sd > 0 AND import_kwh > threshold GROUP BY mprn)"""

STEP_CTE = """
rolled AS (
  SELECT mprn, date, count(*) OVER (PARTITION BY mprn) AS dates,
         CASE WHEN count(min_kwh) OVER f >= 7 THEN avg(min_kwh * 2) OVER f END AS after_kw
  FROM daily WINDOW f AS (PARTITION BY mprn ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
lagged AS (SELECT *, lag(after_kw, 7) OVER (PARTITION BY mprn ORDER BY date) AS before_kw FROM rolled),
steps AS (
  SELECT *, after_kw - before_kw AS delta, (after_kw - before_kw) / before_kw AS shift FROM lagged
  WHERE dates >= 28 AND before_kw > 0.05 AND after_kw > 0.05 AND abs((after_kw - before_kw) / before_kw) > 0.25
  QUALIFY row_number() OVER (PARTITION BY mprn ORDER BY abs((after_kw - before_kw) / before_kw) DESC, date) = 1)"""

SEASON_CTE = """
months AS (SELECT mprn, year_month, sum(import_kwh) AS kwh FROM daily GROUP BY mprn, year_month),
trend AS (
  SELECT *, count(*) OVER (PARTITION BY mprn) AS n,
         avg(kwh) OVER (PARTITION BY mprn ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS trend
  FROM months),
worst AS (
  SELECT *, (kwh - trend) / trend AS deviation FROM trend WHERE n >= 3 AND (kwh - trend) / trend > 0.3
  QUALIFY row_number() OVER (PARTITION BY mprn ORDER BY (kwh - trend) / trend DESC, year_month) = 1)"""

HOURS_CTE = """
hourly AS (SELECT mprn, hour, avg(import_kwh) * 2 AS kw FROM readings WHERE NOT is_weekend GROUP BY mprn, hour),
ramp AS (
  SELECT h.mprn, any_value(baseload_kw) AS base, max(kw) FILTER (WHERE hour = 5) AS early, max(top) AS top,
         coalesce(min(hour) FILTER (WHERE kw > baseload_kw + 0.5 * (top - baseload_kw)), 6) AS ramp_hour
  FROM (SELECT *, max(kw) OVER (PARTITION BY mprn) AS top FROM hourly) h JOIN m USING (mprn) GROUP BY h.mprn),
late AS (SELECT mprn, avg(import_kwh) * 2 AS late_kw FROM readings WHERE hour = 22 GROUP BY mprn)"""

A, I = "'anomaly'", "'insight'"
RULE_SQL = {
    "high_baseload": _finding_sql(
        "high_baseload", "'High Baseload'", "CASE WHEN baseload_kw < 1.0 THEN 'warning' ELSE 'alert' END", A,
        "baseload_kw * per_kw", "baseload_kw", "m WHERE baseload_kw > 0.5"),
    "phantom_load": _finding_sql(
        "phantom_load", "'Phantom Load'", "'warning'", A, "kw * per_kw", "kw",
        "(SELECT mprn, min(min_kwh) * 2 AS kw FROM daily GROUP BY mprn) JOIN m USING (mprn) WHERE kw > 0.2"),
    "consumption_spikes": _finding_sql(
        "consumption_spikes", "spike_days || ' Days with Unusual Spikes'", "'info'", A,
        "excess / range_days * 365 * blended", "spike_days", "spikes JOIN m USING (mprn)"),
    "baseload_step_change": _finding_sql(
        "baseload_step_change", "'Baseload Step-Change'", "CASE WHEN delta > 0 THEN 'warning' ELSE 'info' END",
        "CASE WHEN delta > 0 THEN 'anomaly' ELSE 'insight' END",
        "CASE WHEN delta > 0 THEN delta * per_kw ELSE 0 END", "delta", "steps JOIN m USING (mprn)"),
    "morning_ramp": _finding_sql(
        "morning_ramp", "'Early Morning Ramp'", "'info'", A, "(early - base) * day_rate * 365", "ramp_hour",
        "ramp JOIN m USING (mprn) WHERE base > 0 AND early > base * 1.5 AND top > base"),
    "evening_tail": _finding_sql(
        "evening_tail", "'Late Evening Tail'", "'info'", A, "(late_kw - baseload_kw) * day_rate * 365", "late_kw",
        "late JOIN m USING (mprn) WHERE baseload_kw > 0 AND late_kw > baseload_kw * 1.5"),
    "high_weekend_usage": _finding_sql(
        "high_weekend_usage", "'Higher Weekend Usage'", "'info'", I,
        "(weekend_avg_kwh - weekday_avg_kwh) * 104 * blended", "weekend_avg_kwh / weekday_avg_kwh",
        "m WHERE weekday_avg_kwh > 0 AND weekend_avg_kwh > weekday_avg_kwh * 1.2"),
    "peak_overuse": _finding_sql(
        "peak_overuse", "'Peak Period Overuse'", "CASE WHEN share > 0.18 THEN 'warning' ELSE 'info' END", I,
        "(share - 2 / 24) * (total_import_kwh / range_days * 365) * (peak_rate - day_rate)", "share",
        "(SELECT *, tariff_peak_kwh / total_import_kwh AS share FROM m WHERE total_import_kwh > 0) WHERE share > 0.12"),
    "tariff_optimisation": _finding_sql(
        "tariff_optimisation",
        "CASE WHEN saving > 0 THEN 'Smart Tariff Benefit' ELSE 'Smart Tariff Disadvantage' END",
        "CASE WHEN saving > 0 THEN 'info' ELSE 'warning' END", I,
        "CASE WHEN saving > 0 THEN 0 ELSE -saving END", "saving",
        """(SELECT *, (total_import_kwh * day_rate - (tariff_night_kwh * night_rate + tariff_peak_kwh * peak_rate
            + tariff_day_kwh * day_rate)) / range_days * 365 AS saving FROM m WHERE total_import_kwh > 0)
           WHERE saving > 0 OR saving < -10"""),
    "low_self_consumption": _finding_sql(
        "low_self_consumption", "'Consider Battery Storage'", "'info'", I,
        "total_export_kwh / range_days * 0.6 * day_rate * 365", "ex",
        """(SELECT mprn, sum(daytime_export_kwh) AS ex, coalesce(sum(daytime_import_kwh), 0) AS im FROM daily
            GROUP BY mprn) JOIN m USING (mprn) WHERE total_export_kwh > 0 AND ex > im * 0.5"""),
    "seasonal_variation": _finding_sql(
        "seasonal_variation", "'Seasonal Anomaly'", "'info'", I, "(kwh - trend) * blended", "deviation * 100",
        "worst JOIN m USING (mprn)"),
}
RULE_CTES = {
    "consumption_spikes": SPIKES_CTE, "baseload_step_change": STEP_CTE, "seasonal_variation": SEASON_CTE,
    "morning_ramp": HOURS_CTE, "evening_tail": HOURS_CTE,
}
COLUMNS = FINDING.split(", ")


def _register_rule(rule: str) -> None:
    seasonal = rule == "seasonal_variation"
    base = f"{DAILY_READINGS_SQL},{DAILY_SQL},{TOTALS_SQL}" if seasonal else METER_SQL
    ctes = base + ("," + RULE_CTES[rule] if rule in RULE_CTES else "")

    @query(f"anomaly_{rule}", rounded_sql(RULE_SQL[rule], "annual_cost_eur, value", ctes))
    def run(spark, sf):
        source = daily_readings(spark, sf) if seasonal else readings(spark, sf)
        return an.detect_anomalies(source, rules=[rule]).select(COLUMNS)


for _rule in an.RULES:
    _register_rule(_rule)

ALL_CTES = ",".join([METER_SQL, SPIKES_CTE, STEP_CTE, SEASON_CTE, HOURS_CTE])
ALL_FINDINGS_CTE = "findings AS (" + " UNION ALL ".join(
    f"SELECT *, {i} AS rule_no FROM ({sql})" for i, sql in enumerate(RULE_SQL.values())
) + ")"


@query(
    "anomaly_all",
    rounded_sql(f"SELECT {FINDING}, rule_no::INTEGER AS rule_no FROM findings", "annual_cost_eur, value",
                f"{ALL_CTES},{ALL_FINDINGS_CTE}"),
)
def anomaly_all(spark, sf):
    return an.detect_anomalies(readings(spark, sf)).select(*COLUMNS, "rule_no")


@query(
    "anomaly_spike_dates",
    rounded_sql(
        """SELECT mprn, unnest(dates) AS spike_date, threshold FROM spikes""", "threshold",
        f"{READINGS_SQL},{DAILY_SQL},{SPIKES_CTE}"),
)
def anomaly_spike_dates(spark, sf):
    return an.spike_days(readings(spark, sf))


@query(
    "anomaly_rollup",
    rounded_sql(
        """SELECT mprn, coalesce(sum(annual_cost_eur) FILTER (WHERE category = 'anomaly'), 0.0) AS annual_waste_eur,
           coalesce(sum(annual_cost_eur) FILTER (WHERE category = 'insight'), 0.0) AS annual_savings_eur,
           count(*) AS findings, count(*) FILTER (WHERE severity = 'alert') AS alert_count,
           count(*) FILTER (WHERE severity = 'warning') AS warning_count,
           count(*) FILTER (WHERE severity = 'info') AS info_count FROM findings GROUP BY mprn""",
        "annual_waste_eur, annual_savings_eur", f"{ALL_CTES},{ALL_FINDINGS_CTE}"),
)
def anomaly_rollup(spark, sf):
    return an.anomaly_rollup(an.detect_anomalies(readings(spark, sf)))


@query(
    "anomaly_top3",
    rounded_sql(
        f"""SELECT {FINDING}, row_number() OVER (PARTITION BY mprn ORDER BY rule_no)::INTEGER AS position
            FROM findings WHERE category = 'anomaly' AND severity IN ('warning', 'alert')
            QUALIFY position <= 3""",
        "annual_cost_eur, value", f"{ALL_CTES},{ALL_FINDINGS_CTE}"),
)
def anomaly_top3(spark, sf):
    return an.top_alerts(an.detect_anomalies(readings(spark, sf))).select(*COLUMNS, "position")


@query(
    "anomaly_by_severity",
    f"""WITH {ALL_CTES},{ALL_FINDINGS_CTE}
        SELECT mprn, type, severity, row_number() OVER (PARTITION BY mprn ORDER BY
          CASE severity WHEN 'alert' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_no)::INTEGER AS position
        FROM findings""",
)
def anomaly_by_severity(spark, sf):
    found = an.by_severity(an.detect_anomalies(readings(spark, sf)))
    return found.select("mprn", "type", "severity", "position")


FLEX_FINDINGS = """
flex AS (SELECT mprn, CASE CAST(substr(mprn, 11, 1) AS INTEGER) % 3
                WHEN 0 THEN '30min' WHEN 1 THEN 'daily' ELSE 'monthly' END AS granularity FROM m)"""


@query(
    "anomaly_flexible",
    rounded_sql(
        """
SELECT mprn, granularity, type, title, severity, category, annual_cost_eur, value
FROM findings JOIN flex USING (mprn) WHERE granularity = '30min'
UNION ALL
SELECT mprn, granularity, type, title, severity, NULL, NULL, value FROM findings JOIN flex USING (mprn)
WHERE granularity = 'daily' AND type IN ('high_weekend_usage', 'consumption_spikes')
UNION ALL
SELECT mprn, granularity, 'monthly_outliers', spike_days || ' Months with Unusual Consumption', 'info', NULL, NULL,
       spike_days FROM spikes JOIN flex USING (mprn) WHERE granularity = 'monthly'""",
        "annual_cost_eur, value", f"{ALL_CTES},{ALL_FINDINGS_CTE},{FLEX_FINDINGS}"),
)
def anomaly_flexible(spark, sf):
    found = an.detect_anomalies_flexible(with_code(readings(spark, sf)))
    return found.select("mprn", "granularity", "type", "title", "severity", "category", "annual_cost_eur", "value")


@query(
    "anomaly_custom_rates",
    rounded_sql(
        """
SELECT mprn, CASE WHEN t % 3 = 1 THEN 'Custom' ELSE CASE WHEN t % 2 = 0 THEN 'Energia' ELSE 'Flogas' END END AS provider,
       (total_import_kwh * d - (tariff_night_kwh * n + tariff_peak_kwh * p + tariff_day_kwh * d)) / range_days * 365
         AS saving
FROM (SELECT *, CASE WHEN t % 2 = 0 THEN 0.2781 ELSE 0.2602 END + CASE WHEN t % 3 = 1 THEN 0.02 ELSE 0 END AS d,
             CASE WHEN t % 2 = 0 THEN 0.1529 ELSE 0.1878 END AS n, CASE WHEN t % 2 = 0 THEN 0.3122 ELSE 0.3079 END AS p
      FROM (SELECT *, CAST(substr(mprn, 11, 1) AS INTEGER) AS t FROM m))
WHERE (total_import_kwh * d - (tariff_night_kwh * n + tariff_peak_kwh * p + tariff_day_kwh * d)) > 0""",
        "saving", METER_SQL),
)
def anomaly_custom_rates(spark, sf):
    """Tariff chosen per meter, a third of them with an edited day rate."""
    source = readings(spark, sf)
    t = F.substring("mprn", 11, 1).cast("int")
    even = t % 2 == 0
    day = F.when(even, 27.81).otherwise(26.02)
    choices = source.select("mprn").distinct().select(
        "mprn", F.when(even, "Energia").otherwise("Flogas").alias("provider"),
        F.when(t % 3 == 1, day + 2).otherwise(day).alias("day_cents"),
        F.lit(None).cast("double").alias("night_cents"), F.lit(None).cast("double").alias("peak_cents"),
    )
    rates = tariffs.resolve_choice(choices)
    found = an.detect_anomalies(source, rates, rules=["tariff_optimisation"]).filter("title = 'Smart Tariff Benefit'")
    return found.join(rates.select("mprn", "provider"), "mprn").select(
        "mprn", "provider", F.col("value").alias("saving")
    )


# ---------------------------------------------------------------- filters


@query(
    "filter_last_30d",
    rounded_sql(
        """SELECT mprn, datetime, import_kwh FROM readings r JOIN (SELECT mprn, max(date) AS l FROM readings GROUP BY 1)
           USING (mprn) WHERE date >= l - 29""",
        "import_kwh", DAILY_READINGS_SQL),
)
def filter_last_30d(spark, sf):
    return filters.by_period(daily_readings(spark, sf), "30d").select("mprn", "datetime", "import_kwh")


@query(
    "filter_dates",
    rounded_sql(
        """SELECT mprn, datetime, import_kwh FROM readings
           WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'""",
        "import_kwh", DAILY_READINGS_SQL),
)
def filter_dates(spark, sf):
    import datetime as dt

    kept = filters.between_dates(daily_readings(spark, sf), dt.date(1997, 3, 1), dt.date(1997, 5, 31))
    return kept.select("mprn", "datetime", "import_kwh")


@query(
    "filter_tariff",
    rounded_sql(
        "SELECT mprn, datetime, import_kwh, tariff_period FROM readings WHERE tariff_period IN ('Peak', 'Night')",
        "import_kwh", READINGS_SQL),
)
def filter_tariff(spark, sf):
    kept = filters.by_tariff(readings(spark, sf), ["Peak", "Night"])
    return kept.select("mprn", "datetime", "import_kwh", "tariff_period")

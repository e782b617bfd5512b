"""Bill verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.operators import verify as vf
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import VERIFY_SQL, case_readings, verify_bills


def verified(spark, sf):
    return vf.verify(verify_bills(spark, sf), case_readings(spark, sf))


@query(
    "verify_validate",
    rounded_sql(
        """SELECT bill_idx, mprn IS NULL AS mprn_skipped, coalesce(mprn = hdf_mprn, false) AS mprn_match, billing_days::INTEGER AS billing_days,
           overlap_days::INTEGER AS overlap_days, overlap_pct, block_reason, NOT mismatch AND undated AS needs_dates, block_reason IS NULL AS valid,
           (CASE WHEN mprn IS NULL THEN 1 ELSE 0 END + CASE WHEN block_reason IS NULL AND overlap_pct < 50 THEN 1 ELSE 0 END
            + CASE WHEN block_reason IS NULL AND overlap_pct < 100 THEN 1 ELSE 0 END)::INTEGER AS issue_count FROM checked""",
        "overlap_pct", VERIFY_SQL),
)
def verify_validate(spark, sf):
    return vf.validate(verify_bills(spark, sf), case_readings(spark, sf)).select(
        "bill_idx", "mprn_skipped", "mprn_match", "billing_days", "overlap_days", "overlap_pct", "block_reason", "needs_dates",
        "valid", F.size("issues").alias("issue_count"))


@query(
    "verify_by_mprn",
    rounded_sql(
        """SELECT bill_idx, mprn IS NULL AS mprn_skipped, hdf_mprn IS NOT NULL AS mprn_match, reason AS block_reason,
             billing_days::INTEGER AS billing_days, overlap_days::INTEGER AS overlap_days,
             coalesce(CASE WHEN reason IS NULL THEN (SELECT sum(r.import_kwh) FROM readings r
               WHERE r.mprn = m.hdf_mprn AND r.date BETWEEN m.bill_start AND m.bill_end) END, 0.0) AS hdf_total_kwh
           FROM (SELECT *, CASE WHEN undated THEN 'no billing period' WHEN mprn IS NULL THEN 'no MPRN and no case'
                   WHEN hdf_start IS NULL THEN 'no meter readings' WHEN billing_days <= 0 THEN 'period ends before it starts'
                   WHEN overlap_days = 0 THEN 'no overlap' END AS reason
                 FROM (SELECT *, CASE WHEN billing_days > 0
                         THEN greatest(0, least(bill_end, hdf_end) - greatest(bill_start, hdf_start)) ELSE 0 END AS overlap_days
                       FROM (SELECT *, CASE WHEN NOT undated AND hdf_start IS NOT NULL THEN bill_end - bill_start ELSE 0 END AS billing_days
                             FROM (SELECT vb.*, bill_start IS NULL OR bill_end IS NULL AS undated, h.* FROM vb
                                   LEFT JOIN (SELECT mprn AS hdf_mprn, min(date) AS hdf_start, max(date) AS hdf_end
                                              FROM readings GROUP BY 1) h ON h.hdf_mprn = vb.mprn)))) m""",
        "hdf_total_kwh", VERIFY_SQL),
)
def verify_by_mprn(spark, sf):
    """A table of bills and a table of readings, without cases."""
    out = vf.verify(verify_bills(spark, sf).drop("case_id"), case_readings(spark, sf).drop("case_id"))
    return out.select("bill_idx", "mprn_skipped", "mprn_match", "block_reason", "billing_days", "overlap_days", "hdf_total_kwh")


PERIODS = [("Day", "hdf_day", "day_b"), ("Night", "hdf_night", "night_b"), ("Peak", "hdf_peak", "NULL::DOUBLE"), ("Total", "hdf_total", "total_b")]


@query(
    "verify_consumption",
    rounded_sql(
        "SELECT *, bill_kwh - meter_kwh AS delta_kwh, (bill_kwh - meter_kwh) / nullif(meter_kwh, 0) * 100 AS delta_pct FROM (" + " UNION ALL ".join(
            f"SELECT bill_idx, {i}::INTEGER AS row_no, '{p}' AS period, {h} AS meter_kwh, CASE WHEN ok THEN {b} END AS bill_kwh FROM ver"
            for i, (p, h, b) in enumerate(PERIODS)) + ")",
        "meter_kwh, bill_kwh, delta_kwh, delta_pct", VERIFY_SQL),
)
def verify_consumption(spark, sf):
    return vf.consumption_deltas(verified(spark, sf))


COSTS = [("Day", "hdf_day", "0.28::DOUBLE"), ("Night", "hdf_night", "0.15::DOUBLE"), ("Peak", "hdf_peak", "peak_rate")]


@query(
    "verify_cost",
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT bill_idx, {i}::INTEGER AS row_no, '{p} Energy' AS component, {h} AS meter_kwh, {r} AS bill_rate, {h} * {r} AS expected_cost "
            f"FROM ver WHERE ok AND {r} IS NOT NULL" for i, (p, h, r) in enumerate(COSTS)),
        "meter_kwh, bill_rate, expected_cost", VERIFY_SQL),
)
def verify_cost(spark, sf):
    return vf.cost_rows(verified(spark, sf))


@query(
    "verify_cost_difference",
    rounded_sql(
        """SELECT bill_idx, x AS expected_cost_total, CASE WHEN ok THEN cost END AS bill_cost_total,
           CASE WHEN ok AND x <> 0 THEN cost - x END AS difference
           FROM (SELECT *, CASE WHEN ok THEN hdf_day * 0.28 + hdf_night * 0.15 + coalesce(hdf_peak * peak_rate, 0) END AS x FROM ver)""",
        "expected_cost_total, bill_cost_total, difference", VERIFY_SQL),
)
def verify_cost_difference(spark, sf):
    return vf.cost_difference(verified(spark, sf))


PRESETS = {"day": (0.2814, 0.2781, 0.2602), "night": (0.1479, 0.1529, 0.1878), "peak": (0.3002, 0.3122, 0.3079)}
BILLED = {"day": "0.28::DOUBLE", "night": "0.15::DOUBLE", "peak": "peak_rate"}


@query(
    "verify_rates",
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT bill_idx, {i}::INTEGER AS row_no, '{t.title()}' AS period, CASE WHEN ok THEN {BILLED[t]} END AS bill_rate, "
            f"CASE supplier WHEN 'Electric Ireland' THEN {p[0]} WHEN 'Energia' THEN {p[1]} WHEN 'Flogas' THEN {p[2]} END::DOUBLE AS preset_rate FROM ver"
            for i, (t, p) in enumerate(PRESETS.items())),
        "bill_rate, preset_rate", VERIFY_SQL),
)
def verify_rates(spark, sf):
    return vf.rate_comparison(verified(spark, sf))


@query(
    "verify_status",
    rounded_sql(
        """SELECT bill_idx, d AS delta_pct, CASE WHEN d <= 5 THEN 'Match' WHEN d <= 15 THEN 'Review' WHEN d IS NOT NULL THEN 'Discrepancy' END AS status
           FROM (SELECT bill_idx, CASE WHEN ok AND hdf_total <> 0 AND total_b <> 0 THEN abs((total_b - hdf_total) / hdf_total) * 100 END AS d FROM ver)""",
        "delta_pct", VERIFY_SQL),
)
def verify_status(spark, sf):
    return vf.status_band(verified(spark, sf)).select("bill_idx", "delta_pct", "status")


@query(
    "verify_export",
    rounded_sql(
        """SELECT bill_idx, hdf_export AS hdf_export_kwh, NULL::DOUBLE AS bill_export_units, CASE WHEN credit IS NOT NULL THEN hdf_export * 0.185 END AS expected_credit,
           credit AS bill_export_credit FROM ver WHERE hdf_export > 0""",
        "hdf_export_kwh, bill_export_units, expected_credit, bill_export_credit", VERIFY_SQL),
)
def verify_export(spark, sf):
    return vf.export_check(verified(spark, sf))


@query(
    "verify_standing",
    f"WITH {VERIFY_SQL} SELECT bill_idx, sdays AS bill_standing_days, billing_days::INTEGER AS billing_days, sdays = billing_days AS days_match FROM ver WHERE ok",
)
def verify_standing(spark, sf):
    return vf.standing_check(verified(spark, sf))

import datetime as dt

from pyspark.sql import functions as F

from wattmill.operators import verify as vf
from wattmill.operators.readings import with_features


def _readings(spark):
    data = [(1, "10000000001", dt.datetime(2025, 1, 1) + dt.timedelta(minutes=30 * i), 0.25, 0.1) for i in range(48 * 31)]
    return with_features(spark.createDataFrame(
        data, "case_id long, mprn string, datetime timestamp_ntz, import_kwh double, export_kwh double"))


def _bills(spark, rows):
    schema = ("bill_idx long, case_id long, mprn string, billing_period_start string, billing_period_end string, "
              "day_rate double, night_rate double, peak_rate double")
    df = spark.createDataFrame(rows, schema).withColumn("supplier", F.lit("Energia"))
    for c in ("day_units_kwh", "night_units_kwh", "peak_units_kwh", "total_units_kwh", "total_this_period",
              "standing_charge_total", "export_units", "export_credit"):
        df = df.withColumn(c, F.lit(100.0))
    return df.withColumn("standing_charge_days", F.lit(9))


def test_reasons_and_metered_totals(spark):
    bills = _bills(spark, [
        (1, 1, "10000000001", "05/01/2025", "14/01/2025", 0.3, 0.1, None),
        (2, 1, "10999999999", "05/01/2025", "14/01/2025", 0.3, 0.1, None),
        (3, 1, None, "25/12/2024", "03/01/2025", None, None, None),
        (4, 1, "10000000001", None, "14/01/2025", 0.3, 0.1, None),
        (5, 1, "10000000001", "05/06/2025", "14/06/2025", 0.3, 0.1, None),
        (6, 1, "10000000001", "14/01/2025", "05/01/2025", 0.3, 0.1, None),
    ])
    got = {r["bill_idx"]: r for r in vf.verify(bills, _readings(spark)).collect()}
    assert [got[i]["block_reason"] for i in range(1, 7)] == [
        None, "meter mismatch", None, "no billing period", "no overlap", "period ends before it starts"]
    # Both ends of the period are metered: ten days of 48 readings.
    assert round(got[1]["hdf_total_kwh"], 6) == 10 * 48 * 0.25
    assert round(got[1]["expected_cost_total"], 6) == round(10 * (26 * 0.25 * 0.3 + 18 * 0.25 * 0.1), 6)
    assert got[3]["mprn_skipped"] and round(got[3]["hdf_total_kwh"], 6) == 3 * 48 * 0.25


def test_bills_are_paired_by_mprn_without_cases(spark):
    readings = _readings(spark)
    second = readings.withColumn("mprn", F.lit("10000000002"))
    bills = _bills(spark, [
        (1, 1, " 10000000001", "05/01/2025", "14/01/2025", 0.3, 0.1, None),
        (2, 1, "10000000009", "05/01/2025", "14/01/2025", 0.3, 0.1, None),
        (3, 1, None, "05/01/2025", "14/01/2025", 0.3, 0.1, None),
    ])
    both = readings.unionByName(second)
    got = {r["bill_idx"]: r for r in vf.verify(bills.drop("case_id"), both.drop("case_id")).collect()}
    assert [got[i]["block_reason"] for i in (1, 2, 3)] == [None, "no meter readings", "no MPRN and no case"]
    assert round(got[1]["hdf_total_kwh"], 6) == 10 * 48 * 0.25
    # Two meters in one case are not added up either.
    got = {r["bill_idx"]: r for r in vf.verify(bills, both).collect()}
    assert [got[i]["block_reason"] for i in (1, 2, 3)] == [None, "meter mismatch", "no MPRN and several meters"]
    assert round(got[1]["hdf_total_kwh"], 6) == 10 * 48 * 0.25


def test_totals_equal_sums_of_reads_over_gaps(spark):
    """As-of lookup against adding up the reads, with gaps, a wrong year, asked dates outside and no reads at all."""
    day = dt.datetime(2025, 1, 1)
    reads = [(c, m, day + dt.timedelta(days=k * step, hours=k % 24), 0.1 * k, None if k % 3 else 0.5 * k)
             for c, m, step in ((1, "A", 1), (1, " B ", 3), (2, "A", 10)) for k in range(20)]
    reads += [(1, "A", dt.datetime(2920, 5, 5, 12), 7.0, 1.0), (2, "A", dt.datetime(1925, 5, 5), None, None)]
    readings = with_features(spark.createDataFrame(
        reads, "case_id long, mprn string, datetime timestamp_ntz, import_kwh double, export_kwh double"))
    dates = [dt.date(1900, 1, 1), dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2025, 1, 7), dt.date(2025, 2, 20),
             dt.date(2500, 1, 1), dt.date(2920, 5, 5), dt.date(3000, 1, 1)]
    asked = [(c, m, d) for c, m in ((1, "A"), (1, "B"), (2, "A"), (3, "A")) for d in dates]
    table = spark.createDataFrame(asked * 2 + [(1, "A", None)], "case_id long, hdf_mprn string, on_date date")
    got = vf.totals_up_to(readings, table).collect()
    assert sorted((r.case_id, r.hdf_mprn, r.on_date) for r in got) == sorted(asked)
    for r in got:
        mine = [x for x in reads if x[0] == r.case_id and x[1].strip() == r.hdf_mprn and x[2].date() <= r.on_date]
        assert r.sums.reads == len(mine)
        assert abs(float(r.sums.total or 0) - sum(x[3] or 0 for x in mine)) < 1e-6
        assert abs(float(r.sums.export or 0) - sum(x[4] or 0 for x in mine)) < 1e-6
        assert abs(float(r.sums.day + r.sums.night + r.sums.peak) - sum(x[3] or 0 for x in mine)) < 1e-6


def test_bills_that_repeat_an_id_keep_their_own_figures(spark):
    bills = _bills(spark, [(1, 1, "10000000001", "05/01/2025", "14/01/2025", 0.3, 0.1, None),
                           (1, 1, "10000000001", "05/01/2025", "09/01/2025", 0.3, 0.1, None),
                           (1, 1, "10999999999", "05/01/2025", "09/01/2025", 0.3, 0.1, None)])
    got = sorted(round(r["hdf_total_kwh"], 6) for r in vf.verify(bills, _readings(spark)).collect())
    assert got == [0.0, 5 * 48 * 0.25, 10 * 48 * 0.25]

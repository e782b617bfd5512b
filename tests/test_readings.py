import datetime as dt

from frames import rows
from pyspark.sql import functions as F

from wattmill.operators import anomalies, cleaning, mapping, quality
from wattmill.operators.readings import localise, normalise_reads, with_features


def test_dublin_clock_changes(spark):
    walls = ["2025-10-26 01:30:00", "2025-03-30 01:30:00", "2025-07-01 12:00:00", "2025-01-01 12:00:00"]
    df = spark.createDataFrame([(w,) for w in walls], "w string").select(F.col("w").cast("timestamp_ntz").alias("datetime"))
    got = {str(r[0])[:16] for r in localise(df).select(F.col("datetime_utc").cast("string")).collect()}
    # Second pass of the repeated hour, and the missing hour moved to the change.
    assert got == {"2025-10-26 01:30", "2025-03-30 01:00", "2025-07-01 11:00", "2025-01-01 12:00"}


def test_reads_with_units_and_missing_exports(spark):
    raw = spark.createDataFrame(
        [
            ("a", 1, "10000000001", "0.4", "Active Import Interval (kWh)", "01-03-2025 00:30"),
            ("a", 2, "10000000001", "0.1", "Active Export Interval (kWh)", "01-03-2025 00:30"),
            ("a", 3, "10000000001", "0.5", "Active Import Interval (kWh)", "01-03-2025 01:00"),
            ("a", 4, "10000000001", "0.9", "Active Export Interval (kWh)", "01-03-2025 01:30"),
            ("b", 1, "10000000002", "3.0", "Active Import Interval (kW)", "01/03/2025 17:30"),
        ],
        "file_id string, row_idx long, mprn string, read_value string, read_type string, read_time string",
    )
    got = rows(normalise_reads(raw).select("mprn", "import_kwh", "export_kwh", "tariff_period"), "mprn", "import_kwh")
    assert got == [("10000000001", 0.4, 0.1, "Night"), ("10000000001", 0.5, 0.0, "Night"), ("10000000002", 1.5, 0.0, "Peak")]


def _series(spark, kwh_by_hour, days=30):
    data = [("10000000001", dt.datetime(2025, 1, 1) + dt.timedelta(days=d, hours=h, minutes=m), kwh_by_hour(d, h), 0.0)
            for d in range(days) for h in range(24) for m in (0, 30)]
    df = spark.createDataFrame(data, "mprn string, datetime timestamp_ntz, import_kwh double, export_kwh double")
    return with_features(df)


def test_quiet_meter_has_only_the_tariff_finding(spark):
    found = {r["type"] for r in anomalies.detect_anomalies(_series(spark, lambda d, h: 0.05)).collect()}
    assert found == {"tariff_optimisation"}


def test_step_change_and_ramp(spark):
    def load(day, hour):
        return (0.2 if day < 15 else 0.4) + (0.6 if hour == 5 else 0.0)

    found = {r["type"]: r for r in anomalies.detect_anomalies(_series(spark, load)).collect()}
    assert found["baseload_step_change"]["category"] == "anomaly"
    assert found["morning_ramp"]["value"] == 5.0
    assert "evening_tail" not in found


def test_steps_across_midnight_match_a_plain_lag(spark):
    data = [("m", dt.datetime(2025, 1, 1, 23, 30)), ("m", dt.datetime(2025, 1, 2, 0, 0)), ("m", dt.datetime(2025, 1, 5, 6, 0))]
    series = spark.createDataFrame(data, "mprn string, datetime timestamp_ntz")
    got = sorted(r["gap_seconds"] for r in quality.time_steps(series).collect())
    assert got == [1800.0, 3 * 86400.0 + 6 * 3600.0]


def test_similarity_against_a_plain_table():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for a, b in [("total cost", "cost total"), ("units consumed kwh", "units consumed"), ("abc", "xyz"), ("mprn no", "mprn")]:
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert mapping.token_sort_ratio(a, b) == 200.0 * lcs(x, y) / (len(x) + len(y))


def test_negative_imports_and_missing_values(spark):
    df = spark.createDataFrame(
        [("f", 1, "01/02/2025", "-2.5", None, None, "€3.00", False, False), ("f", 2, "02/13/2025", "1,000.5", None, None, "x", False, False),
         ("f", 3, "03/02/2025", None, None, None, None, False, False)],
        "file_id string, row_idx long, datetime string, import_kwh string, export_kwh string, mprn string, cost string, "
        "has_export boolean, has_mprn boolean")
    got = rows(cleaning.parse_rows(df).select("import_kwh", "export_kwh", "cost", "mprn", "date_swapped", F.col("datetime").cast("date").cast("string")), "row_idx")
    assert got == [(0.0, 2.5, 3.0, "Unknown", False, "2025-02-01"), (1000.5, 0.0, None, "Unknown", True, "2025-02-13"),
                   (None, 0.0, None, "Unknown", False, "2025-02-03")]


def test_every_spike_day_is_a_row_and_the_finding_shows_five(spark):
    series = _series(spark, lambda d, h: 1.0 if d % 15 == 3 else 0.05, days=105)
    days = rows(anomalies.spike_days(series).select(F.col("spike_date").cast("string")), "spike_date")
    assert days == [(str(dt.date(2025, 1, 1) + dt.timedelta(days=d)),) for d in range(3, 105, 15)] and len(days) == 7
    found, = anomalies.detect_anomalies(series, rules=["consumption_spikes"]).collect()
    assert found["value"] == 7 and [(str(d),) for d in found["dates"]] == days[:5]

"""Columns found by content, and printed totals that end on half a unit."""

from datetime import datetime, timedelta

from wattmill.operators import mapping, stats
from wattmill.operators.readings import with_features


def test_dates_with_the_month_first_make_a_date_column(spark):
    days = [datetime(2024, 1, 13) + timedelta(days=i) for i in range(50)]
    cells = ["n.a." if i < 5 else f"{d:%m/%d/%Y}" if i < 10 else f"{d:%d/%m/%Y}" for i, d in enumerate(days)]
    rows = spark.createDataFrame([("f", i, [c]) for i, c in enumerate(cells)], "file_id string, row_idx long, cells array<string>")
    headers = spark.createDataFrame([("f", 0, "Col A")], "file_id string, col_idx int, column_name string")
    found = mapping.candidate_rows(mapping.detect_columns(rows, headers)).collect()
    assert [(r.field, r.column_name, r.tier) for r in found] == [("datetime", "Col A", 3)]


def test_totals_do_not_depend_on_the_order_of_adding(spark):
    values = [0.1, 0.1, 0.1]
    start = datetime(2024, 1, 1)
    rows = [("10000000001", start + timedelta(days=i), v, 0.05) for i, v in enumerate(values)]
    series = with_features(spark.createDataFrame(rows, "mprn string, datetime timestamp_ntz, import_kwh double, export_kwh double"))
    (row,) = stats.summary_stats(series).collect()
    assert (row.total_import_kwh, row.net_import_kwh) == (0.3, 0.15)


def test_totals_of_values_beyond_the_decimals_are_plain_sums(spark):
    rows = [("10000000001", datetime(2024, 1, 1 + i), v, 0.0) for i, v in enumerate([1e30, 1e30])]
    series = with_features(spark.createDataFrame(rows, "mprn string, datetime timestamp_ntz, import_kwh double, export_kwh double"))
    (row,) = stats.summary_stats(series).collect()
    assert row.total_import_kwh == 2e30


def test_rows_of_one_file_meet_their_file_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from wattmill.sources import spreadsheets

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.lit("f").alias("file_id"), F.col("id").alias("row_idx"))
        files = spark.createDataFrame([("f", 7)], "file_id string, top int")
        met = spreadsheets.join_per_file(rows, files).select("row_idx", "top", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert sorted(r.row_idx for r in met) == list(range(1000)) and {r.top for r in met} == {7}
    assert len({r.task for r in met}) > 4

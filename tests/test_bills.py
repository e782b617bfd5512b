import datetime as dt

from frames import rows
from pyspark.sql import functions as F

from wattmill.functions.dates import with_dates
from wattmill.operators import bills, filters, fuel
from wattmill.operators.ranking import number_rows


def test_bill_date_layouts(spark):
    texts = ["05/03/2025", "5 Mar 2025", "5 March 2025", "05.03.2025", "2025-03-05", "05-03-2025", "05/03/25", "5 mar 25",
             "  5  Mar 2025 ", "30/02/2025", "TBC", "", None, "5 Marsh 2025", "01/01/75"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in with_dates(df, {"d": "t"}).orderBy("i").select("d").collect()]
    day = dt.date(2025, 3, 5)
    assert got == [day] * 9 + [None] * 5 + [dt.date(1975, 1, 1)]


def test_segments_and_prorated_sums(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2025, 1, 15), dt.date(2025, 2, 15), 310.0), (2, dt.date(2024, 2, 1), dt.date(2024, 3, 1), None),
         (3, dt.date(2025, 5, 1), dt.date(2025, 5, 1), 9.0)],
        "bill_idx int, period_start date, period_end date, total_cost double")
    for c in bills.PRORATED[1:]:
        df = df.withColumn(c, F.lit(None).cast("double"))
    assert rows(bills.month_segments(df).select("bill_idx", "days"), "bill_idx", "month") == [(1, 17), (1, 14), (2, 29)]
    got = rows(bills.monthly_prorated(df).select("month", F.round("total_cost", 6), "total_kwh", "days_covered"), "month")
    assert got == [(dt.date(2024, 2, 1), None, None, 29), (dt.date(2025, 1, 1), 170.0, None, 17), (dt.date(2025, 2, 1), 140.0, None, 14)]


def test_numbering_is_the_same_for_any_cut(spark):
    data = [(i, "x" if i % 3 else "y", dt.date(2025, 1, 1 + i % 5) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(data, "bill_idx long, g string, d date")
    whole = rows(number_rows(df, ["g"], "d", "bill_idx"), "bill_idx")
    cut = rows(number_rows(df, ["g"], "d", "bill_idx", bucket_rows=4), "bill_idx")
    assert whole == cut
    ordered = sorted((r for r in data if r[1] == "y"), key=lambda r: (r[2] is None, r[2] or dt.date.max, r[0]))
    position = {r[0]: r[3] for r in whole}
    assert [position[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_mprn_filter(spark):
    df = spark.createDataFrame([("1",), (" 1 ",), ("",), (None,), ("2",)], "mprn string")
    assert filters.by_mprn(df, ["1"]).count() == 2
    assert filters.by_mprn(df, ["1", filters.NO_MPRN_LABEL]).count() == 4
    assert filters.by_mprn(df, []).count() == 0
    assert filters.by_mprn(df.withColumnRenamed("mprn", "x"), ["1"]).count() == 5


def test_fuel_errors_and_lookups(spark):
    df = spark.createDataFrame([("coal", 2.0, "tonne"), ("coal", 2.0, "litre"), ("turf", 1.0, "tonne"), ("lpg", 0.0, "kg")],
                               "fuel_type string, quantity double, unit string")
    got = {(r["fuel_type"], r["unit"]): (r["kwh"], r["error"] is None) for r in fuel.convert_to_kwh(df).collect()}
    assert got == {("coal", "tonne"): (16280.0, True), ("coal", "litre"): (None, False), ("turf", "tonne"): (None, False),
                   ("lpg", "kg"): (0.0, True)}
    assert [r["unit"] for r in fuel.all_units(spark).orderBy("position").collect()] == [
        "tonne", "bag_40kg", "bag_25kg", "bale_12_5kg", "litre", "kg"]

"""Plans of the evaluation queries: what grows with the input is neither gathered by the driver nor computed twice."""

import collections
import datetime

import pytest

import __spark_entry__ as entry
from wattmill.operators import evaluate as ev
from wattmill.operators import extract as ex

EVALUATIONS = ["eval_fields", "eval_accuracy", "eval_aggregate", "eval_accuracy_all"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Orders whose file is far below the size up to which Spark broadcasts a table."""
    folder = tmp_path_factory.mktemp("orders")
    rows = [(i, 1, "O", 1000.0 + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i % 300)) for i in range(1, 200)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")
    frame.coalesce(1).write.parquet(str(folder / "orders.parquet"))
    return str(folder)


def nodes(plan):
    """How often each operator stands in a plan, and stages that are read again."""
    lines = [x.strip(" :+-*()0123456789") for x in plan.split("\n")]
    return collections.Counter(x.split(" ")[0] for x in lines if x)


@pytest.mark.parametrize("name", EVALUATIONS)
def test_evaluation_joins_broadcast_nothing(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not nodes(plan)["BroadcastExchange"] and nodes(plan)["SortMergeJoin"]


def test_bills_are_extracted_once_for_fields_and_providers(spark, sf):
    df = entry.queries()["eval_accuracy"](spark, sf)
    rows = {int(r.filename): r for r in df.collect()}
    assert set(rows) == {i for i in range(1, 200) if i % 9}
    assert all(r.provider_match and r.accuracy == 1.0 for i, r in rows.items() if i % 7 == 0)
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert nodes(final)["ArrowEvalPython"] == 2  # provider and rules


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_providers_are_detected_once_for_reconciled_fields(spark, sf):
    df = entry.queries()["reconcile_fields"](spark, sf)
    assert nodes(plan_of(df))["ArrowEvalPython"] == 2  # provider and rules
    assert {r.bill_id for r in df.select("bill_id").distinct().collect()} == {i for i in range(1, 200) if i % 7 != 3}


def field_rows(spark, rows):
    """Rows of (bill_id, {field: value}) with field columns, of confidence 0.7."""
    kind = ", ".join(f"{f} {ex.FIELD}" for f in ex.FIELDS)
    made = [(i, *[(fields[f], 0.7, 0) if f in fields else None for f in ex.FIELDS]) for i, fields in rows]
    return spark.createDataFrame(made, f"bill_id long, {kind}")


def test_repairs_and_checks_are_columns_that_queries_can_leave_out(spark):
    bills = field_rows(spark, [(1, {"day_rate": "25.5", "day_kwh": "100", "subtotal": "50.00", "vat_rate": "9"})])
    healed = ex.heal_totals(ex.compute_costs(ex.fix_rates(bills.withColumn("provider_name", ex.F.lit("Energia")))))
    checked = ex.validate_fields(healed)
    assert not nodes(plan_of(checked))["Generate"] and nodes(plan_of(ex.to_long(checked)))["Generate"] == 1
    assert "totals_crosscheck" in plan_of(checked.select("checks"))
    values = {r.field_name: r.value for r in ex.to_long(checked).collect()}
    assert values == {"day_rate": "0.255", "day_kwh": "100", "day_cost": "25.50", "subtotal": "50.00", "vat_rate": "9",
                      "vat_amount": "4.50", "total_incl_vat": "54.50"}


def test_both_sides_are_decided_from_one_comparison(spark):
    ours = field_rows(spark, [(1, {"mprn": "10", "subtotal": "1,000.00", "account_number": "A", "billing_period": "x"}),
                              (2, {"mprn": None}), (2, {"mprn": "11"}), (None, {"mprn": "12"})])
    theirs = field_rows(spark, [(1, {"mprn": "10", "subtotal": "1000.001", "account_number": "B", "billing_period": "y", "gprn": "7"}),
                                (2, {"mprn": "11"}), (3, {"mprn": "13"}), (None, {"mprn": "14"})])
    both = ex.reconcile_bills(ours, theirs, None)
    assert plan_of(both).count("regexp_replace") <= 6  # one comparison for all fields and both sides
    for side, prefer in (("own", False), ("external", True)):
        one = ex.reconcile_bills(ours, theirs, prefer)
        assert both.filter(ex.F.col("preferred") == side).drop("preferred").exceptAll(one).isEmpty()
        got = {r.field_name: r for r in ex.to_long(one.filter("bill_id = 1")).collect()}
        assert got["subtotal"].value == "1,000.00" and got["subtotal"].confidence == pytest.approx(0.8)
        assert got["account_number"].value == ("B" if prefer else "A") and got["billing_period"].value == "y"
        assert got["gprn"].value == "7"
        assert sorted(str(r.bill_id) for r in one.collect()) == ["1", "2", "2", "3", "None", "None"]
    left = ex.reconcile_bills(ours, theirs, False, how="left")
    assert sorted(str(r.bill_id) for r in left.collect()) == ["1", "2", "2", "None"]


def test_dates_are_only_parsed_where_texts_are_not_numbers(spark):
    texts = [("5", "5.01"), ("5", "5.1"), ("1,000", "1000"), ("1 Jan 2024", "01/01/2024"), ("Abc", "aBC"), ("2024-31-12", "31/12/2024"),
             ("5", "x"), ("2024-01-02", "02/01/24"), ("5", None)]
    frame = spark.createDataFrame(texts, "expected string, actual string")
    parsed = ev._with_parsed(frame, ["expected", "actual"]).withColumn("same", ev.values_match("expected", "actual"))
    assert [r.same for r in parsed.collect()] == [True, False, True, True, True, True, False, True, None]
    assert parsed.filter("_expected_number is not null and _actual_number is not null and _expected_text is not null").isEmpty()

"""The queries over all bills: every bill and field is there, and values agree with the printed ones."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattmill.queries import extract, whole
from wattmill.queries.views import bill_values, bills, ocr_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def truth(spark):
    return {r.bill_id: r for r in bill_values(spark, SF).filter("bill_id % 5 = 0").collect()}


@pytest.fixture(scope="module", autouse=True)
def routed_once(spark, tmp_path_factory):
    """The extracted bills of every layout, scanned and native, computed once for all queries."""
    path = str(tmp_path_factory.mktemp("whole") / "routed")
    extract.routed(spark, SF).filter("bill_id % 5 = 0").write.parquet(path)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whole, "routed", lambda spark, sf: spark.read.parquet(path))
        for name in ("bill_values", "external_records", "bill_texts"):
            full = getattr(whole, name)
            patch.setattr(whole, name, lambda spark, sf, full=full: full(spark, sf).filter("bill_id % 5 = 0"))
        yield


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_scanned_bills_of_every_layout_are_read(spark, truth):
    lost = {r.doc_id for r in ocr_words(spark, SF).filter("conf = -1").select("doc_id").distinct().collect()}
    every = {r.bill_id: r for r in bill_values(spark, SF).collect()}
    found = collections.defaultdict(dict)
    for r in run(spark, "ocr_fields_all"):
        assert r.field_name not in found[r.doc_id]
        found[r.doc_id][r.field_name] = r.value
    scanned = {i for i, v in every.items() if v.scanned}
    assert set(found) <= scanned and lost & set(found)
    assert {every[i].layout for i in found} == set(range(7))
    legible = [i for i in scanned - lost if every[i].layout == 0]
    assert legible and all(found[i]["mprn"] == every[i].mprn and float(found[i]["subtotal"]) == float(every[i].net)
                           and found[i]["day_kwh"] == str(every[i].dk) for i in legible)


def test_flat_fields_of_every_supplier(spark, truth):
    rows = run(spark, "extract_flat_all")
    assert sorted(r.bill_id for r in rows) == sorted(truth)
    assert {r.supplier for r in rows} == {"Energia", "Electric Ireland", "SSE Airtricity", "Unknown"}
    assert all(r.mprn == truth[r.bill_id].mprn for r in rows if r.supplier == "Electric Ireland")


def test_routed_bills_native_and_scanned(spark, truth):
    healed = {r.bill_id: r for r in run(spark, "heal_fields_all")}
    scores = {r.bill_id: r for r in run(spark, "bill_confidence_all")}
    flat = {r.bill_id: r for r in run(spark, "extracted_flat_bills_all")}
    assert set(healed) == set(scores) == set(flat) == set(truth)
    checks = {(r.bill_id, r.name): r.passed for r in run(spark, "validate_fields_all")}
    assert {truth[i].layout for i, _ in checks} == set(range(7)) and any(truth[i].scanned for i, _ in checks)
    native = [i for i, v in truth.items() if v.layout == 0 and not v.scanned]
    assert native and all(flat[i].mprn == truth[i].mprn and scores[i].band == "accept" for i in native)
    assert all(p for (i, _), p in checks.items() if i in native)
    assert all(healed[i].total_incl_vat == float(truth[i].total) for i in native)


def test_reconciled_fields_of_every_layout(spark, truth):
    rows = run(spark, "reconcile_fields_all")
    assert {r.bill_id for r in rows} == set(truth)
    assert {"mprn", "account_number", "day_kwh", "day_rate", "day_cost", "subtotal"} <= {r.field_name for r in rows}
    seen = collections.Counter((r.preferred, r.bill_id, r.field_name) for r in rows)
    assert max(seen.values()) == 1
    for r in rows:
        if r.preferred == "external" and r.field_name == "account_number":
            assert r.value == truth[r.bill_id].account


def test_evaluation_counts_scanned_bills(spark, truth):
    values = entry.queries()
    results = run(spark, "eval_fields_all")
    assert {int(r.filename) for r in results} == set(truth)
    skip = {4: {"mprn", "day_kwh", "night_kwh"}, 5: {"day_kwh", "night_kwh"}}
    assert len(results) == sum(6 - len(skip.get(v.layout, ())) for v in truth.values())
    assert all(r.status == "MATCH" for r in results if truth[int(r.filename)].layout == 0
               and not truth[int(r.filename)].scanned)
    weight = {True: 2, False: 1}
    total, hit = collections.Counter(), collections.Counter()
    for r in results:
        total[r.filename] += weight[r.critical]
        hit[r.filename] += weight[r.critical] * (r.status == "MATCH")
    scores = {r.filename: r.accuracy for r in run(spark, "eval_accuracy_all")}
    assert scores == pytest.approx({f: hit[f] / total[f] for f in total}, abs=1e-7)
    one, = values["eval_aggregate_all"](spark, SF).collect()
    assert one.aggregate_accuracy == pytest.approx(sum(hit.values()) / sum(total.values()), abs=1e-7)
    assert one.fixtures_evaluated == len(truth) and one.fixtures_skipped == 0


def test_sheets_hold_every_field(spark):
    rows = run(spark, "export_comparison_bills_all")
    per_bill = collections.Counter((r.bill_idx, r.sheet) for r in rows)
    assert len(per_bill) == bills(spark, SF).count() and len(set(per_bill.values())) == 1
    narrow = entry.queries()["export_comparison_bills"](spark, SF)
    every = entry.queries()["export_comparison_bills_all"](spark, SF).filter(F.col("field").isin("Status", "Bill Date"))
    assert narrow.exceptAll(every.select(narrow.columns)).isEmpty() and set(per_bill.values()).pop() > 2

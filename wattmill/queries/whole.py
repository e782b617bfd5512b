"""Bill queries over all bills and fields, beside the SQL-backed ones of the same name that read a part.

Lost words, scanned pages and the layouts no provider rules cover give values SQL cannot derive from the printed
numbers, so these have no SQL; `tests/test_whole.py` checks them against the true values and the narrow queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.functions.steps import computed_once
from wattmill.operators import evaluate as ev
from wattmill.operators import extract as ex
from wattmill.operators import flat_extract as fx
from wattmill.operators import spatial as sp
from wattmill.plans.bill_extraction import to_flat_bills
from wattmill.queries.bills import BY, compared
from wattmill.queries.extract import CRITICAL, external_records, fixtures, routed, truth_of
from wattmill.queries.registry import query
from wattmill.queries.spatial import words
from wattmill.queries.views import bill_texts, bill_values, bills
from wattmill.sources import exports


@query("ocr_fields_all")
def ocr_fields_all(spark, sf):
    """Every field of every scanned bill of any provider, with lost words or without."""
    return ex.to_long(sp.extract_spatial(words(spark, sf)).withColumn(
        "provider", F.lit(None).cast(ex.FIELD)), "doc_id").drop("pattern_index")


@query("extract_flat_all")
def extract_flat_all(spark, sf):
    """Flat fields of every bill text of any supplier."""
    return fx.extract_flat(bill_texts(spark, sf)).drop("text").withColumn("warnings", F.array_join("warnings", "; "))


@query("heal_fields_all")
def heal_fields_all(spark, sf):
    return routed(spark, sf).select("bill_id", *[ex.safe_float(ex.value_of(f)).alias(f)
                                                 for f in ("vat_rate", "vat_amount", "total_incl_vat")])


@query("validate_fields_all")
def validate_fields_all(spark, sf):
    return ex.check_rows(routed(spark, sf))


@query("bill_confidence_all")
def bill_confidence_all(spark, sf):
    return routed(spark, sf).select("bill_id", "bill_type", "fields_found", "expected_fields", "score", "band")


@query("extracted_flat_bills_all")
def extracted_flat_bills_all(spark, sf):
    return to_flat_bills(routed(spark, sf))


@query("reconcile_fields_all")
def reconcile_fields_all(spark, sf):
    """Every field of the extracted bills, native and scanned, against external records, decided for either side."""
    own, other = routed(spark, sf).select("bill_id", *ex.FIELDS), ex.external_fields(external_records(spark, sf))

    both = ex.reconcile_bills(own, other, None)
    keyed = both.withColumn("key", F.struct("preferred", "bill_id")).drop("preferred", "bill_id")
    return ex.to_long(keyed, "key").select("key.preferred", "key.bill_id", "field_name", "value", "confidence")


def _scored(spark, sf, done):
    truth = truth_of(bill_values(spark, sf))
    return truth, ev.field_results(truth, ex.to_long(done, "filename"), CRITICAL)


@query("eval_fields_all")
def eval_fields_all(spark, sf):
    return _scored(spark, sf, fixtures(routed(spark, sf)))[1].select("filename", "field_name", "critical", "status")


@query("eval_accuracy_all")
def eval_accuracy_all(spark, sf):
    done = computed_once(fixtures(routed(spark, sf)), "filename")
    _, results = _scored(spark, sf, done)
    return ev.fixture_accuracy(results, done.select("filename", "detected_provider"))


@query("eval_aggregate_all")
def eval_aggregate_all(spark, sf):
    truth, results = _scored(spark, sf, fixtures(routed(spark, sf)))
    return ev.aggregate_accuracy(truth, results)


@query("export_comparison_bills_all")
def export_comparison_bills_all(spark, sf):
    """Every field row of every bill's sheet."""
    return exports.comparison_tables(compared(spark, sf), bills(spark, sf), BY)["bills"]

"""Bill-text queries: the expected values come straight from the numbers the texts were composed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill import extraction_rules as R
from wattmill.functions.steps import computed_once, staged
from wattmill.operators import evaluate as ev
from wattmill.operators import extract as ex
from wattmill.operators import flat_extract as fx
from wattmill.operators import spatial as sp
from wattmill.plans.bill_extraction import extract_bills, to_flat_bills
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import (
    BILL_LINES_SQL, BILL_VALUES_SQL, LAYOUTS, bill_pages, bill_texts, bill_values, ocr_words, table,
)

_NAMES = "[" + ", ".join(f"'{n}'" for n in LAYOUTS) + "]"


@query(
    "text_quality",
    r"""SELECT doc_id, length(s) < 50 OR len(regexp_extract_all(s, '[a-zA-Z]{3,}')) < 5
          OR coalesce(length(regexp_replace(v, '\P{L}', '', 'g')) / nullif(length(v), 0), 1) < 0.40 AS low_quality
        FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, regexp_replace(text, '\s', '', 'g') AS v FROM documents)""",
)
def text_quality(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ex.is_low_quality(F.col("text")).alias("low_quality"))


@query(
    "page_assembly",
    f"""WITH {BILL_LINES_SQL} SELECT bill_id, CASE WHEN scanned THEN 1 ELSE 2 END::BIGINT AS page_count,
          CASE WHEN scanned THEN 'Il lI 1l %% 12' ELSE first || chr(10) || chr(10) || second END AS text,
          NOT scanned AND (length(first) + length(second)) / 2 >= 60 AS is_native
        FROM (SELECT *, array_to_string(lines[1:len(lines) // 2], chr(10)) AS first,
                     array_to_string(lines[len(lines) // 2 + 1:], chr(10)) AS second FROM texts)""",
)
def page_assembly(spark, sf):
    return ex.assemble_pages(bill_pages(spark, sf), 60).select("bill_id", "page_count", "text", "is_native")


@query(
    "provider_detect",
    f"""WITH {BILL_VALUES_SQL} SELECT bill_id, {_NAMES}[layout + 1] AS provider, layout <> 3 AS is_known FROM vals""",
)
def provider_detect(spark, sf):
    return ex.detect_provider(bill_texts(spark, sf)).select("bill_id", "provider", "is_known")


# Signatures present in the seven layouts: a name (3), or a name and a web address (6).
@query(
    "supplier_detect",
    rounded_sql(
        """SELECT bill_id, CASE layout WHEN 0 THEN 'Energia' WHEN 1 THEN 'Electric Ireland' WHEN 2 THEN 'SSE Airtricity'
             ELSE 'Unknown' END AS supplier, CASE WHEN layout < 3 THEN 0.27 ELSE 0 END::DOUBLE AS supplier_confidence FROM vals""",
        "supplier_confidence", BILL_VALUES_SQL),
)
def supplier_detect(spark, sf):
    return ex.detect_supplier(bill_texts(spark, sf)).select("bill_id", "supplier", "supplier_confidence")


NUMBERS = ["day_kwh", "day_rate", "day_cost", "night_kwh", "night_rate", "subtotal", "vat_rate", "vat_amount", "total_incl_vat"]
TEXTS = ["mprn", "account_number", "billing_period", "standing_charge"]


def _read(df, texts=TEXTS, numbers=NUMBERS):
    return df.select("bill_id", *[ex.value_of(f).alias(f) for f in texts],
                     *[ex.safe_float(ex.value_of(f)).alias(f) for f in numbers])


CONFIG_SQL = """
SELECT bill_id, CASE WHEN layout <> 4 THEN mprn END AS mprn,
       CASE WHEN layout IN (0, 1, 2, 6) THEN account WHEN layout = 5 THEN substr(mprn, 2) END AS account_number,
       CASE layout WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN p WHEN 5 THEN '29 Feb 24 - 30 Apr 24' WHEN 6 THEN '1 Jan 24 to 31 Jan 24' END AS billing_period,
       CASE layout WHEN 0 THEN '30 - 0.55 - 16.50' WHEN 1 THEN '30 - 0.55 - 16.50' WHEN 2 THEN '30.00 - 0.5500 - 16.50'
            WHEN 5 THEN '61 - 0.5500 - 33.55' WHEN 6 THEN '16.50' END AS standing_charge,
       CASE layout WHEN 0 THEN dk WHEN 1 THEN dk + 0.5 WHEN 2 THEN dk WHEN 6 THEN dk END::DOUBLE AS day_kwh,
       CASE WHEN layout IN (0, 1, 2, 6) THEN dr END::DOUBLE AS day_rate,
       CASE layout WHEN 0 THEN dc WHEN 6 THEN dc END::DOUBLE AS day_cost,
       CASE layout WHEN 0 THEN nk WHEN 1 THEN nk + 0.25 WHEN 2 THEN nk END::DOUBLE AS night_kwh,
       CASE WHEN layout IN (0, 1, 2) THEN nr END::DOUBLE AS night_rate,
       net::DOUBLE AS subtotal, CASE WHEN layout = 4 THEN 13.5 ELSE 9 END::DOUBLE AS vat_rate,
       CASE WHEN layout = 4 THEN vat ELSE printed_vat END::DOUBLE AS vat_amount,
       CASE WHEN layout = 4 OR NOT no_total THEN total END::DOUBLE AS total_incl_vat
FROM (SELECT *, strftime(s, '%d/%m/%Y') || ' - ' || strftime(e, '%d/%m/%Y') AS p FROM vals) WHERE layout <> 3"""


@query("extract_config", rounded_sql(CONFIG_SQL, ", ".join(NUMBERS), BILL_VALUES_SQL))
def extract_config(spark, sf):
    known = ex.detect_provider(bill_texts(spark, sf)).filter(ex.has_rules(F.col("provider"))).withColumnRenamed(
        "provider", "provider_name")
    cleaned = staged(known, {"cleaned": ex.clean_text(F.col("text"), F.col("provider_name"))})
    return _read(ex.provider_fields(cleaned, "cleaned", "provider_name").select("bill_id", "x.*"))


@query(
    "extract_universal",
    rounded_sql(
        """SELECT bill_id, mprn, account AS account_number, NULL::VARCHAR AS gprn, dk::DOUBLE AS day_kwh, dr::DOUBLE AS day_rate,
           nk::DOUBLE AS night_kwh, nr::DOUBLE AS night_rate, 16.5::DOUBLE AS standing_charge, 2.01::DOUBLE AS pso_levy,
           net::DOUBLE AS subtotal, 9::DOUBLE AS vat_rate, printed_vat::DOUBLE AS vat_amount,
           CASE WHEN NOT no_total THEN total END::DOUBLE AS total_incl_vat FROM vals WHERE layout = 3""",
        "day_kwh, day_rate, night_kwh, night_rate, standing_charge, pso_levy, subtotal, vat_rate, vat_amount, total_incl_vat",
        BILL_VALUES_SQL),
)
def extract_universal(spark, sf):
    unknown = ex.detect_provider(bill_texts(spark, sf)).filter("NOT is_known").drop("provider")
    fields = ex.universal_fields(unknown, "text").select("bill_id", "x.*")
    return _read(fields, ["mprn", "account_number", "gprn"],
                 ["day_kwh", "day_rate", "night_kwh", "night_rate", "standing_charge", "pso_levy", "subtotal", "vat_rate",
                  "vat_amount", "total_incl_vat"])


FLAT_NUMBERS = ("day_units_kwh, day_rate, day_cost, night_units_kwh, night_rate, total_units_kwh, standing_charge_total, "
                "subtotal_before_vat, vat_rate_pct, vat_amount, total_this_period")


@query(
    "extract_flat",
    rounded_sql(
        """SELECT bill_id, mprn, account AS account_number, strftime(s, '%d/%m/%Y') AS billing_period_start,
           strftime(e, '%d/%m/%Y') AS billing_period_end, dk + 0.5::DOUBLE AS day_units_kwh, dr::DOUBLE AS day_rate, dc::DOUBLE AS day_cost,
           nk + 0.25::DOUBLE AS night_units_kwh, nr::DOUBLE AS night_rate, dk + nk + 0.75::DOUBLE AS total_units_kwh,
           30::INTEGER AS standing_charge_days, 16.5::DOUBLE AS standing_charge_total, net::DOUBLE AS subtotal_before_vat,
           9::DOUBLE AS vat_rate_pct, printed_vat::DOUBLE AS vat_amount,
           CASE WHEN NOT no_total THEN total END::DOUBLE AS total_this_period FROM vals WHERE layout = 1""",
        FLAT_NUMBERS, BILL_VALUES_SQL),
)
def extract_flat(spark, sf):
    flat = fx.extract_flat(bill_texts(spark, sf)).filter("supplier = 'Electric Ireland'")
    return flat.select("bill_id", "mprn", "account_number", "billing_period_start", "billing_period_end",
                       "standing_charge_days", *[c.strip() for c in FLAT_NUMBERS.split(",")])


@query("extract_flat_warnings")
def extract_flat_warnings(spark, sf):
    flat = fx.extract_flat(bill_texts(spark, sf))
    return flat.select("bill_id", "confidence_score", F.array_join("warnings", "; ").alias("warnings"))


def _documents(spark, sf):
    return ex.assemble_pages(bill_pages(spark, sf), 60)


def _words(spark, sf):
    return sp.extract_spatial(sp.clean_words(ocr_words(spark, sf)))


def routed(spark, sf):
    return extract_bills(_documents(spark, sf), _words(spark, sf).withColumnRenamed("doc_id", "bill_id"))


@query(
    "heal_fields",
    rounded_sql(
        """SELECT bill_id, CASE WHEN layout = 4 THEN 13.5 ELSE 9 END::DOUBLE AS vat_rate,
           CASE WHEN layout = 4 THEN CASE WHEN abs(round(net * 0.135, 2) - vat) / round(net * 0.135, 2) > 1 THEN round(net * 0.135, 2) ELSE vat END
                ELSE vat END::DOUBLE AS vat_amount, total::DOUBLE AS total_incl_vat FROM vals WHERE NOT scanned""",
        "vat_rate, vat_amount, total_incl_vat", BILL_VALUES_SQL),
)
def heal_fields(spark, sf):
    native = extract_bills(_documents(spark, sf)).filter("is_native")
    return _read(native, [], ["vat_rate", "vat_amount", "total_incl_vat"])


@query(
    "validate_fields",
    f"""WITH {BILL_VALUES_SQL} SELECT bill_id, c.name, true AS passed FROM vals,
          LATERAL (SELECT unnest(['totals_crosscheck', 'vat_math', 'mprn_format', 'total_reasonable', 'vat_rate_range',
            'day_rate_range', 'night_rate_range', 'day_kwh_range', 'night_kwh_range', 'day_cost_consistency',
            'night_cost_consistency']) AS name) c WHERE layout = 0 AND NOT scanned""",
)
def validate_fields(spark, sf):
    native = extract_bills(_documents(spark, sf)).filter("is_native AND provider_name = 'Energia'")
    return ex.check_rows(native)


@query(
    "bill_confidence",
    rounded_sql(
        """SELECT bill_id, 'electricity' AS bill_type, 10::INTEGER AS fields_found, 10::INTEGER AS expected_fields,
           0.4 + 0.4 + 0.1::DOUBLE AS score, 'accept' AS band FROM vals WHERE layout = 0 AND NOT scanned""",
        "score", BILL_VALUES_SQL),
)
def bill_confidence(spark, sf):
    native = extract_bills(_documents(spark, sf)).filter("is_native AND provider_name = 'Energia'")
    return native.select("bill_id", "bill_type", "fields_found", "expected_fields", "score", "band")


# The one name on a scanned Kerry bill is its first two words; where one of them is lost, nothing names the provider.
@query(
    "route",
    f"""WITH {BILL_VALUES_SQL}, seen AS (
          SELECT *, layout = 3 OR (layout = 4 AND scanned AND (bill_id % 97 = 0 OR (bill_id + 1) % 97 = 0)) AS nameless FROM vals)
        SELECT bill_id, CASE WHEN scanned THEN 'tier0_scanned → tier2_spatial → ' ELSE 'tier0_native → ' END
          || CASE WHEN nameless THEN 'tier1_unknown' ELSE 'tier1_known → tier3_' || replace(lower({_NAMES}[layout + 1]), ' ', '_') END
          || CASE WHEN nameless AND NOT scanned THEN ' → tier2_universal' ELSE '' END AS extraction_method, 'success' AS status FROM seen""",
)
def route(spark, sf):
    return routed(spark, sf).select("bill_id", "extraction_method", "status")


@query(
    "extracted_flat_bills",
    rounded_sql(
        """SELECT bill_id, 'Energia' AS supplier, mprn, strftime(s, '%d/%m/%Y') AS billing_period_start,
           strftime(e, '%d/%m/%Y') AS billing_period_end, dk::DOUBLE AS day_units_kwh, dc::DOUBLE AS day_cost, (dk + nk)::DOUBLE AS total_units_kwh,
           30::INTEGER AS standing_charge_days, 2.01::DOUBLE AS pso_levy, total::DOUBLE AS total_this_period
           FROM vals WHERE layout = 0 AND NOT scanned""",
        "day_units_kwh, day_cost, total_units_kwh, pso_levy, total_this_period", BILL_VALUES_SQL),
)
def extracted_flat_bills(spark, sf):
    native = extract_bills(_documents(spark, sf)).filter("is_native AND provider_name = 'Energia'")
    return to_flat_bills(native).select("bill_id", "supplier", "mprn", "billing_period_start", "billing_period_end",
                                        "day_units_kwh", "day_cost", "total_units_kwh", "standing_charge_days", "pso_levy",
                                        "total_this_period")


def external_records(spark, sf):
    """JSON records another extractor would give: right values, except a wrong subtotal on some bills."""
    v = bill_values(spark, sf)
    return v.select(
        "bill_id",
        F.to_json(F.struct(
            F.lit("ENERGIA").alias("provider"), "mprn", F.col("account").alias("account_number"),
            F.array(F.struct(F.lit("Day energy").alias("description"), F.col("dk").cast("double").alias("quantity"),
                             F.lit("kWh").alias("unit"), F.col("dr").cast("double").alias("unit_price"),
                             F.col("dc").cast("double").alias("line_total"))).alias("line_items"),
            F.when(F.col("bill_id") % 4 == 0, 1.0).otherwise(F.col("net").cast("double")).alias("subtotal"),
        )).alias("json"),
    )


@query(
    "reconcile_fields",
    rounded_sql(
        """
SELECT preferred, bill_id, 'mprn' AS field_name, mprn AS value, NULL::DOUBLE AS amount,
       CASE WHEN layout = 4 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence
FROM vals, (SELECT unnest(['own', 'external']) AS preferred) WHERE layout <> 3
UNION ALL
SELECT preferred, bill_id, 'subtotal', NULL, CASE WHEN differs AND preferred = 'external' THEN 1.0 ELSE net END::DOUBLE,
       CASE WHEN differs AND preferred = 'external' THEN 0.75
            ELSE CASE WHEN layout = 4 THEN 0.8 WHEN layout IN (1, 5) THEN 0.85 ELSE 0.9 END
                 + CASE WHEN differs THEN 0 ELSE 0.1 END END::DOUBLE
FROM (SELECT *, bill_id % 4 = 0 AS differs FROM vals), (SELECT unnest(['own', 'external']) AS preferred) WHERE layout <> 3""",
        "amount, confidence", BILL_VALUES_SQL),
)
def reconcile_fields(spark, sf):
    """Provider rules against external records, as long rows, with conflicts decided for either side."""
    known = ex.detect_provider(bill_texts(spark, sf)).filter(ex.has_rules(F.col("provider")))
    cleaned = staged(known, {"cleaned": ex.clean_text(F.col("text"), F.col("provider"))})
    own = ex.provider_fields(cleaned, "cleaned", "provider").select("bill_id", "x.*")
    other = ex.external_fields(external_records(spark, sf))
    amount = F.col("field_name") == "subtotal"

    both = ex.reconcile_bills(own, other, None, how="left")  # every bill with rules of its own is in `own`
    keyed = both.withColumn("key", F.struct("preferred", "bill_id")).drop("preferred", "bill_id")
    return ex.to_long(keyed, "key").filter(F.col("field_name").isin("mprn", "subtotal")).select(
        "key.preferred", "key.bill_id", "field_name", F.when(~amount, F.col("value")).alias("value"),
        F.when(amount, ex.safe_float(F.col("value"))).alias("amount"), "confidence")


@query(
    "external_fields",
    rounded_sql(
        """SELECT bill_id, unnest(['provider', 'mprn', 'account_number', 'day_kwh', 'day_rate', 'day_cost', 'subtotal']) AS field_name,
             unnest(['ENERGIA', mprn, account, CAST(dk::DOUBLE AS VARCHAR), CAST(dr::DOUBLE AS VARCHAR), CAST(dc::DOUBLE AS VARCHAR),
                     CASE WHEN bill_id % 4 = 0 THEN '1.0' ELSE CAST(net::DOUBLE AS VARCHAR) END]) AS value,
             0.75::DOUBLE AS confidence, -1::INTEGER AS pattern_index FROM vals""",
        "confidence", BILL_VALUES_SQL),
)
def external_fields(spark, sf):
    return ex.to_long(ex.external_fields(external_records(spark, sf)))


# ---------------------------------------------------------------- evaluation against the known values

CRITICAL = ["mprn", "subtotal", "total_incl_vat", "vat_amount"]


def truth_of(v):
    """Ground truth of bill values in long form, with the fields that do not apply per bill."""
    values = {"mprn": "mprn", "subtotal": "net", "vat_amount": "vat", "total_incl_vat": "total", "day_kwh": "dk", "night_kwh": "nk"}
    expected = F.create_map(*[x for f, c in values.items() for x in (F.lit(f), F.col(c).cast("string"))])
    return v.select(
        F.col("bill_id").cast("string").alias("filename"),
        F.get(F.array(*[F.lit(n) for n in LAYOUTS]), F.col("layout")).alias("provider"),
        expected.alias("expected"),
        F.when(F.col("layout") == 4, F.array(F.lit("mprn"), F.lit("day_kwh"), F.lit("night_kwh")))
        .when(F.col("layout") == 5, F.array(F.lit("day_kwh"), F.lit("night_kwh")))
        .otherwise(F.array().cast("array<string>")).alias("not_applicable"),
    )


def _truth(spark, sf):
    return truth_of(bill_values(spark, sf).filter("NOT scanned"))


def fixtures(extracted):
    """Fields and provider of extracted bills by `filename`."""
    return extracted.select(F.col("bill_id").cast("string").alias("filename"),
                            F.col("provider_name").alias("detected_provider"), *ex.FIELDS)


def _native(spark, sf):
    return fixtures(extract_bills(_documents(spark, sf)).filter("is_native"))


def _scored(spark, sf, native):
    return ev.field_results(_truth(spark, sf), ex.to_long(native, "filename"), CRITICAL)


EVAL_SQL = """
f AS (
  SELECT bill_id::VARCHAR AS filename, layout, n.field_name, n.field_name NOT IN ('day_kwh', 'night_kwh') AS critical,
         CASE WHEN n.field_name = 'day_kwh' THEN CASE layout WHEN 1 THEN 'WRONG' ELSE 'MATCH' END
              WHEN n.field_name = 'night_kwh' THEN CASE layout WHEN 1 THEN 'WRONG' WHEN 6 THEN 'MISS' ELSE 'MATCH' END
              WHEN n.field_name = 'vat_amount' AND layout = 4 THEN 'MATCH'
              ELSE 'MATCH' END AS status
  FROM vals, (SELECT unnest(['mprn', 'subtotal', 'vat_amount', 'total_incl_vat', 'day_kwh', 'night_kwh']) AS field_name) n
  WHERE NOT scanned AND NOT (layout = 4 AND n.field_name IN ('mprn', 'day_kwh', 'night_kwh'))
    AND NOT (layout = 5 AND n.field_name IN ('day_kwh', 'night_kwh'))),
acc AS (
  SELECT filename, layout, sum(CASE WHEN critical THEN 2 ELSE 1 END * (status = 'MATCH')::INT) / sum(CASE WHEN critical THEN 2 ELSE 1 END) AS accuracy,
         count(*) FILTER (WHERE status = 'MATCH') AS fields_matched, count(*) FILTER (WHERE status = 'MISS') AS fields_missing
  FROM f GROUP BY 1, 2)"""


@query("eval_fields", f"WITH {BILL_VALUES_SQL},{EVAL_SQL} SELECT filename, field_name, critical, status FROM f")
def eval_fields(spark, sf):
    return _scored(spark, sf, _native(spark, sf)).select("filename", "field_name", "critical", "status")


@query(
    "eval_accuracy",
    rounded_sql(f"SELECT filename, {_NAMES}[layout + 1] AS detected_provider, true AS provider_match, accuracy::DOUBLE AS accuracy, "
                "fields_matched, fields_missing FROM acc", "accuracy", f"{BILL_VALUES_SQL},{EVAL_SQL}"),
)
def eval_accuracy(spark, sf):
    native = computed_once(_native(spark, sf), "filename")
    providers = native.select("filename", "detected_provider")
    return ev.fixture_accuracy(_scored(spark, sf, native), providers).select(
        "filename", "detected_provider", "provider_match", "accuracy", "fields_matched", "fields_missing")


@query(
    "eval_aggregate",
    rounded_sql(
        """SELECT (sum(CASE WHEN critical THEN 2 ELSE 1 END * (status = 'MATCH')::INT) / sum(CASE WHEN critical THEN 2 ELSE 1 END))::DOUBLE
             AS aggregate_accuracy, count(DISTINCT filename) AS fixtures_evaluated, 0::BIGINT AS fixtures_skipped, true AS passed FROM f""",
        "aggregate_accuracy", f"{BILL_VALUES_SQL},{EVAL_SQL}"),
)
def eval_aggregate(spark, sf):
    return ev.aggregate_accuracy(_truth(spark, sf), _scored(spark, sf, _native(spark, sf)))

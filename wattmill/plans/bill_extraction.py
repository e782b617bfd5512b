"""Pages, word tables and external records to structured bills: the whole route in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.functions.steps import by_merge, staged
from wattmill.operators import extract as ex
from wattmill.operators.rules import ANY_PROVIDER, with_found

# Names of the steps a bill went through.
NATIVE, SCANNED, IMAGE, SPATIAL, UNIVERSAL, EXTERNAL, NOTHING = (
    "tier0_native", "tier0_scanned", "image_input", "tier2_spatial", "tier2_universal", "tier4_llm", "insufficient_text"
)


def _steps(*steps: Column) -> Column:
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def extract_bills(
    documents: DataFrame,
    spatial: DataFrame | None = None,
    external: DataFrame | None = None,
) -> DataFrame:
    """Field columns, provider, checks, score, band and route of every document.

    documents(bill_id, text, is_native, is_image); spatial(bill_id, field columns, ocr_text, avg_ocr_confidence) as
    given by `spatial.extract_spatial`; external(bill_id, json) records, used where the score is too low.
    """
    docs = documents if "is_image" in documents.columns else documents.withColumn("is_image", F.lit(False))
    needs_words = F.col("is_image") | (~F.col("is_native") & F.coalesce(ex.is_low_quality(F.col("text")), F.lit(True)))
    docs = staged(docs, {"needs_words": needs_words})
    if spatial is None:
        docs = docs.withColumns({"sp": F.lit(None).cast(_struct_type()), "ocr_text": F.lit(None).cast("string"),
                                 "avg_ocr_confidence": F.lit(None).cast("double")})
    else:
        packed = spatial.select(
            "bill_id", F.struct(*[F.col(f).cast(ex.FIELD).alias(f) for f in ex.FIELDS]).alias("sp"), "ocr_text",
            "avg_ocr_confidence",
        ).filter(F.exists(F.array(*[F.col("sp")[f].isNotNull() for f in ex.FIELDS]), lambda x: x))
        docs = docs.join(by_merge(packed), "bill_id", "left")
    by_words = F.col("needs_words") & F.col("sp").isNotNull()
    docs = docs.withColumn("by_words", by_words).withColumn(
        "text", F.when(F.col("by_words"), F.col("ocr_text")).otherwise(F.col("text"))
    )
    known = ex.detect_provider(docs).withColumnRenamed("provider", "provider_name")
    name, readable = F.col("provider_name"), F.col("by_words") | ~F.col("needs_words")
    scanned = known.withColumn("readable", readable).withColumn("ruled", F.col("readable") & ex.has_rules(name))
    cleaned = staged(scanned, {"body": F.when(F.col("ruled"), ex.clean_text(F.col("text"), name)).otherwise(F.col("text"))})
    key = F.when(F.col("ruled"), name).when(F.col("readable") & ~F.col("by_words"), ANY_PROVIDER)
    scanned = with_found(cleaned, "body", key, ex.FIELDS)
    fields = {f: F.coalesce(F.when(F.col("by_words"), F.col("sp")[f]), F.col("x")[f]) for f in ex.FIELDS}
    wide = scanned.withColumns(fields)
    # Cents are repaired in a provider's own fields, and in every field of a scanned document.
    whole = F.col("by_words") & ~F.col("is_image")
    wide = ex.fix_rates(wide, {
        f: whole | (F.col("ruled") & F.col("x")[f].isNotNull()
                    & ~(F.col("by_words") & F.coalesce(F.col("sp")[f].isNotNull(), F.lit(False))))
        for f in ex.RATE_FIELDS
    }).drop("x", "sp", "body")
    scored = _score(ex.heal_totals(ex.compute_costs(wide)))
    if external is None:
        final = scored.withColumn("escalated", F.lit(False))
    else:
        final = _escalate(scored, external)
    return _with_route(final)


def _struct_type() -> str:
    return "struct<" + ",".join(f"{f}:{ex.FIELD}" for f in ex.FIELDS) + ">"


def _score(df: DataFrame) -> DataFrame:
    ocr = F.when(F.col("by_words"), F.col("avg_ocr_confidence"))
    return ex.score_confidence(ex.validate_fields(df.withColumn("_ocr", ocr)), ocr="_ocr").drop("_ocr")


SCORES = ["checks", "bill_type", "fields_found", "expected_fields", "field_coverage", "pass_rate", "score", "band"]


def _escalate(scored: DataFrame, external: DataFrame) -> DataFrame:
    """Merge the external record into bills with a low score or no readable text; its values win conflicts."""
    records = ex.external_fields(external.select("bill_id", "json")).select(
        "bill_id", F.struct(*ex.FIELDS).alias("ext")
    )
    joined = scored.join(records, "bill_id", "left")
    escalated = F.col("ext").isNotNull() & ((F.col("band") == "escalate") | ~F.col("readable"))
    joined = joined.withColumn("escalated", escalated)
    lift = F.col("escalated")
    both = ex.merged_fields(F.col, lambda f: F.when(lift, F.col("ext")[f]), lambda f: F.lit(True))
    merged = staged(joined, {"_merged": both}).withColumns(ex.from_map("_merged")).drop("_merged")
    # Documents read as text keep their provider; the others take the record's when they have none.
    rename = lift & F.col("needs_words") & (F.col("provider_name") == ex.UNKNOWN)
    merged = merged.withColumn("provider_name", F.when(rename, ex.known_provider(F.col("ext")["provider"]["value"]))
                               .otherwise(F.col("provider_name"))).drop("ext", *SCORES)
    merged = merged.withColumn("is_known", F.col("provider_name") != ex.UNKNOWN)
    return _score(ex.compute_costs(merged))


def _with_route(df: DataFrame) -> DataFrame:
    """`extraction_path`, its text form, and the status of the bill in its batch."""
    start = F.when(F.col("is_image"), IMAGE).when(F.col("is_native"), NATIVE).otherwise(SCANNED)
    tier1 = F.when(F.col("is_known"), "tier1_known").otherwise("tier1_unknown")
    own = F.concat(F.lit("tier3_"), F.replace(F.lower("provider_name"), F.lit(" "), F.lit("_")))
    lifted = F.when(F.col("escalated"), EXTERNAL)
    words = F.when(F.col("needs_words"), SPATIAL)
    read = _steps(start, words, tier1, F.when(F.col("ruled"), own),
                  F.when(~F.col("ruled") & ~F.col("by_words"), UNIVERSAL), lifted)
    unread = F.when(F.col("escalated"), _steps(start, words, lifted, tier1)).otherwise(_steps(start, words, F.lit(NOTHING)))
    path = F.when(F.col("readable"), read).otherwise(unread)
    empty = ~F.col("readable") & ~F.col("escalated")
    return (
        df.withColumn("extraction_path", path)
        .withColumn("extraction_method", F.array_join("extraction_path", " → "))
        .withColumn("field_count", ex.found())
        .withColumn("status", F.when(F.col("text").isNull() & empty, "error").otherwise("success"))
    )


def to_flat_bills(extracted: DataFrame) -> DataFrame:
    """Nested bills, then the flat layout."""
    from wattmill.operators.bills import flatten_bills

    return flatten_bills(ex.build_bills(extracted))

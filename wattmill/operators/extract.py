"""Bill text to structured fields, as expressions over one row per bill.

Each field is a column of type STRUCT<value, confidence, pattern_index>, null when not found.  Texts are
scanned once where they lie; no step shuffles them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill import extraction_rules as R
from wattmill.functions.numbers import PLAIN_NUMBER, to_number
from wattmill.functions.steps import by_merge, staged
from wattmill.operators.rules import FIELD, ANY_PROVIDER, with_found

# Every field any source can give, in the order the long form lists them.
FIELDS = [
    "provider", "mprn", "gprn", "account_number", "invoice_number", "billing_period", "invoice_date",
    "day_kwh", "day_rate", "day_cost", "night_kwh", "night_rate", "night_cost", "peak_kwh", "peak_rate", "peak_cost",
    "standing_charge", "pso_levy", "subtotal", "vat_rate", "vat_amount", "total_incl_vat", "litres", "unit_price",
    "mcc_code", "dg_code", "customer_name", "supply_address",
]
UNKNOWN = "unknown"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- text quality and page assembly

NATIVE_CHARS_PER_PAGE = 100
MIN_CHARS, MIN_WORDS, MIN_ALPHA_RATIO = 50, 5, 0.40


def assemble_pages(pages: DataFrame, native_threshold: int = NATIVE_CHARS_PER_PAGE) -> DataFrame:
    """(bill_id, text, page_count, avg_chars, is_native) from (bill_id, page_no, text)."""
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    # The text of one bill is one value by nature; a bill has few pages.
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n"
    )
    return pages.groupBy("bill_id").agg(
        joined.alias("text"), F.count("*").alias("page_count"), F.avg(F.length(strip)).alias("avg_chars")
    ).withColumn("is_native", F.col("avg_chars") >= native_threshold)


def is_low_quality(text: Column) -> Column:
    """Too short, too few words of three letters, or too few letters among the visible characters."""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    visible = F.regexp_replace(text, r"(?U)\s", "")
    letters = F.length(F.regexp_replace(visible, r"\P{L}", ""))
    return (
        (F.length(stripped) < MIN_CHARS)
        | (F.regexp_count(text, F.lit("[a-zA-Z]{3,}")) < MIN_WORDS)
        | (F.try_divide(letters, F.length(visible)) < MIN_ALPHA_RATIO)
    )


# ---------------------------------------------------------------- provider and supplier


_LETTERS_AND_DIGITS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _bounded_counts(text: str, words: Sequence[str]) -> dict[str, int]:
    """How often each word that occurs stands by itself, next to no ASCII letter or digit; overlaps count."""
    counts = {}
    for word in words:
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if text[at - 1:at] not in _LETTERS_AND_DIGITS and text[end:end + 1] not in _LETTERS_AND_DIGITS:
                counts[word] = counts.get(word, 0) + 1
            at = text.find(word, at + 1)
    return counts


def keyword_counts(text: Column, words: Sequence[str]) -> Column:
    """ARRAY<STRUCT<word, n>> of the bounded words that occur in a lower-case text."""
    words = list(dict.fromkeys(words))

    def count(texts: pa.Array) -> pa.Array:
        found = [None if t is None else _bounded_counts(t, words) for t in texts.to_pylist()]
        return pa.array([f and [{"word": w, "n": n} for w, n in f.items()] or (None if f is None else []) for f in found],
                        pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))

    return F.arrow_udf(count, "array<struct<word:string,n:int>>")(text)


def _provider_table(keywords: dict[str, list[str]]) -> list[tuple]:
    """(provider, its words with those of its own that hide them, longest first), in list order."""
    def hidden_by(w: str, words: Sequence[str]) -> list[str]:
        return [o.lower() for o in words if w.lower() in o.lower() and w.lower() != o.lower()]

    return [(provider, [(w, w.lower(), hidden_by(w, words)) for w in sorted(words, key=len, reverse=True)])
            for provider, words in keywords.items()]


def _provider_finder(keywords: dict[str, list[str]]) -> Callable[[pa.Array], pa.Array]:
    """Function of texts that gives the provider whose bounded keywords occur most, and its longest; null without any.

    Earlier providers win ties. White space counts as one blank.
    """
    words, table = list(dict.fromkeys(w.lower() for ws in keywords.values() for w in ws)), _provider_table(keywords)

    def best(text: str | None) -> tuple[str | None, str | None]:
        counts = _bounded_counts(" ".join(text.lower().split()), words) if text else {}
        most, chosen = 0, (None, None)
        for provider, named in table if counts else ():
            kept = [(w, low) for w, low, longer in named if low in counts and not any(o in counts for o in longer)]
            score = sum(counts[low] for _, low in kept)
            if score > most:
                most, chosen = score, (provider, kept[0][0])
        return chosen

    def find(texts: pa.Array) -> pa.Array:
        found = [best(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["provider", "word"])

    return find


def detect_provider(bills: DataFrame, text: str = "text") -> DataFrame:
    """Add `provider`, `is_known` and `matched_keyword`: the provider whose bounded keywords occur most.

    A keyword inside a longer one of the same provider only counts when the longer one is absent.
    """
    find = F.arrow_udf(_provider_finder(R.PROVIDER_KEYWORDS), "provider string, word string")
    best = F.col("_best")
    return staged(bills, {"_best": find(F.col(text))}).withColumns({
        "provider": F.coalesce(best["provider"], F.lit(UNKNOWN)),
        "is_known": best["provider"].isNotNull(),
        "matched_keyword": best["word"],
    }).drop("_best")


SIGNATURE_WEIGHTS = {"keyword": 3, "phone": 5, "vat": 10, "address": 4}
SUPPLIER_FULL_SCORE = 22.0


def detect_supplier(bills: DataFrame, text: str = "text") -> DataFrame:
    """Add `supplier` and `supplier_confidence` from weighted signatures; earlier suppliers win ties."""
    body, lowered, best = F.col(text), F.col("_lowered"), F.col("_best")
    ranked = []
    for rank, (supplier, signature) in enumerate(R.SUPPLIER_SIGNATURES.items()):
        tests = [(lowered.contains(k.lower()), SIGNATURE_WEIGHTS["keyword"]) for k in signature["keywords"]]
        tests += [(body.contains(p), SIGNATURE_WEIGHTS["phone"]) for p in signature["phone"]]
        tests += [(body.contains(signature[k]), SIGNATURE_WEIGHTS[k]) for k in ("vat", "address") if signature[k]]
        score = sum((F.when(test, weight).otherwise(0) for test, weight in tests), F.lit(0))
        ranked.append(F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(supplier).alias("supplier")))
    scored = staged(staged(bills, {"_lowered": F.lower(body)}), {"_best": F.array_max(F.array(*ranked))})
    share = F.round(F.least(best["score"] / SUPPLIER_FULL_SCORE, F.lit(1.0)), 2)
    return scored.withColumns({
        "supplier": F.when(best["score"] > 0, best["supplier"]).otherwise("Unknown"),
        "supplier_confidence": F.when(best["score"] > 0, share).otherwise(0.0),
    }).drop("_lowered", "_best")


# ---------------------------------------------------------------- clean-up before a provider's rules


def _chain(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


# Repairs of common misreadings, in order.
_ENERGIA_REPAIRS = [
    (r"(?U)\b[eEc][uU][rR][oO]\b", "€"), (r"(?U)@[\s_~=]+", "@ "), (r"(?U)(€[\d,]+):(\d{2})", "$1.$2"),
    (r"(?U)(\d,\d+):(\d{2})\b", "$1.$2"), (r"(?U)\bTatal\b", "Total"), (r"(?U)\bXWh\b", "kWh"), (r"(?U)\bxWh\b", "kWh"),
]
_KERRY_REPAIRS = [(r"(?U)\s*[|—]\s*", " "), (r"(?U)(\d),(\d)", "$1$2"), (r"  +", " ")]
_SUMMARY = r"(?iU)Day[\s\S]{0,400}?(\d{1,3},\d{3})\s+(\d{1,3},\d{3})\s+(\d{1,2})\s+Days"
_AMOUNT = r"(?U)€?\s*([\d,]+\.\d{2})"


def _clean_energia(text: Column) -> Column:
    """Repairs, then helper lines for a collapsed tariff summary and for the amount excluding VAT."""
    def with_lines(t: Column) -> Column:
        day, night, days = (F.regexp_extract(t, _SUMMARY, i) for i in (1, 2, 3))
        summary = F.when(
            days != "",
            F.concat(F.lit("\nDay Energy "), day, F.lit(" kWh\nNight Energy "), night,
                     F.lit(" kWh\nStanding Charge "), days, F.lit(" Days")),
        )
        amounts = F.filter(
            F.transform(
                F.filter(F.split(t, "\n"),
                         lambda line: F.lower(line).contains("excluding") & F.lower(line).contains("vat")),
                lambda line: F.regexp_extract_all(line, F.lit(_AMOUNT), F.lit(1)),
            ),
            lambda found: F.size(found) > 0,
        )
        net = F.concat(F.lit("\nTotal Excluding VAT €"), F.try_element_at(F.get(amounts, F.lit(0)), F.lit(-1)))
        return F.regexp_replace(F.concat(t, F.coalesce(summary, F.lit("")), F.coalesce(net, F.lit(""))), "  +", " ")

    return _bind(_chain(text, _ENERGIA_REPAIRS), with_lines)


CLEANUPS: dict[str, Callable[[Column], Column]] = {
    "energia": _clean_energia,
    "kerry": lambda text: _chain(text, _KERRY_REPAIRS),
}


def clean_text(text: Column, provider: Column) -> Column:
    """Provider-specific repairs; other texts stay as they are.  New hooks go into `CLEANUPS`."""
    out = text
    for name, hook in R.PROVIDER_CLEANUP.items():
        out = F.when(provider == name, CLEANUPS[hook](text)).otherwise(out)
    return out


# ---------------------------------------------------------------- pattern extraction


def _field(value: Column, confidence: Column | float, index: int) -> Column:
    level = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(value.alias("value"), level.cast("double").alias("confidence"), F.lit(index).alias("pattern_index"))


def _if_found(value: Column, confidence: float, index: int) -> Column:
    """Field from a text that is empty or null when nothing matched; the text is evaluated once."""
    return F.get(F.transform(F.filter(F.array(value), lambda v: v != ""), lambda v: _field(v, confidence, index)), F.lit(0))


def _no_field() -> Column:
    return F.lit(None).cast(FIELD)


def _spread(fields: dict[str, Column]) -> Column:
    """All known fields as one struct; those not given are null."""
    return F.struct(*[fields.get(name, _no_field()).cast(FIELD).alias(name) for name in FIELDS])


def universal_fields(df: DataFrame, text: str, when: Column | None = None) -> DataFrame:
    """df with `x`, the fields that provider-independent rules find in a text column where `when` holds."""
    key = F.lit(ANY_PROVIDER) if when is None else F.when(when, ANY_PROVIDER)
    return with_found(df, text, key, FIELDS)


def provider_fields(df: DataFrame, text: str, provider: str) -> DataFrame:
    """df with `x`, the fields that a provider's own rules find in its cleaned text (see `clean_text`), null without rules."""
    return with_found(df, text, F.col(provider), FIELDS)


def has_rules(provider: Column) -> Column:
    return provider.isin(list(R.PROVIDER_RULES))


# ---------------------------------------------------------------- long form


def found(columns: Sequence[str] = FIELDS) -> Column:
    """Number of known fields among the field columns."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def found_names(columns: Sequence[str] = FIELDS) -> Column:
    return F.filter(F.array(*[F.when(F.col(c).isNotNull(), c) for c in columns]), lambda n: n.isNotNull())


def to_long(bills: DataFrame, key: str = "bill_id", columns: Sequence[str] = FIELDS) -> DataFrame:
    """(key, field_name, value, confidence, pattern_index), one row per known field."""
    entries = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("field_name"), F.col(c)["value"].alias("value"),
            F.col(c)["confidence"].alias("confidence"), F.col(c)["pattern_index"].alias("pattern_index")))
        for c in columns
    ])
    return bills.select(key, F.inline(entries)).filter(F.col("field_name").isNotNull())


def hit_rate(bills: DataFrame) -> DataFrame:
    """Share of the rules in play (the provider's, else the universal ones) that found their field."""
    sizes = F.lit(len(R.UNIVERSAL_PATTERNS))
    for name, rules in R.PROVIDER_RULES.items():
        sizes = F.when(F.col("provider_name") == name, len(rules)).otherwise(sizes)
    return bills.withColumn("field_count", found()).withColumn("hit_rate", F.col("field_count") / sizes)


def value_of(field: str) -> Column:
    return F.col(field)["value"]


def safe_float(text: Column) -> Column:
    """Number before any '(', with everything but digits, dots and minus signs removed."""
    digits = F.regexp_replace(F.substring_index(F.trim(text), "(", 1), r"[^0-9.\-]", "")
    return F.regexp_extract(digits, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))$", 1).try_cast("double")


# ---------------------------------------------------------------- repairs across fields

RATE_FIELDS = ["day_rate", "night_rate", "peak_rate"]
RATE_MAX = 1.0
TRIPLETS = [("day_cost", "day_rate", "day_kwh"), ("night_cost", "night_rate", "night_kwh"),
            ("peak_cost", "peak_rate", "peak_kwh")]
COMPUTED, CORRECTED = 0.70, 0.75
VAT_MAX = 23


def _note(df: DataFrame, notes: list[Column]) -> DataFrame:
    """Append the non-null notes to `warnings`."""
    added = F.filter(F.array(*notes), lambda n: n.isNotNull())
    before = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
    return df.withColumn("warnings", F.concat(before, added))


def _with_numbers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    # Plain columns, here and in the repairs: no filter uses them, and what a query does not ask for is then not computed.
    return df.withColumns({f"_{f}": safe_float(value_of(f)) for f in fields})


def _without_numbers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.drop(*[f"_{f}" for f in fields])


def fix_rates(df: DataFrame, when: dict[str, Column] | None = None) -> DataFrame:
    """Rates above 1 EUR/kWh are cents; `when` limits the repair per rate field."""
    numbers = _with_numbers(df, RATE_FIELDS)
    notes, updates = [], {}
    for f in RATE_FIELDS:
        too_high = F.col(f"_{f}") > RATE_MAX
        if when is not None:
            too_high = when[f] & too_high
        euros = F.round(F.col(f"_{f}") / 100, 4).cast("string")
        fixed = F.struct(euros.alias("value"), F.col(f)["confidence"].alias("confidence"),
                         F.col(f)["pattern_index"].alias("pattern_index"))
        updates[f] = F.when(too_high, fixed).otherwise(F.col(f))
        notes.append(F.when(too_high, F.concat(F.lit(f"{f} read as cents: "), value_of(f))))
    return _without_numbers(_note(numbers, notes).withColumns(updates), RATE_FIELDS)


def compute_costs(df: DataFrame) -> DataFrame:
    """Missing or non-positive costs become rate times kWh."""
    names = [n for t in TRIPLETS for n in t]
    numbers = _with_numbers(df, names)
    notes, updates = [], {}
    for cost, rate, kwh in TRIPLETS:
        missing = ~F.coalesce(F.col(f"_{cost}") > 0, F.lit(False))
        known = (F.col(f"_{rate}") > 0) & (F.col(f"_{kwh}") > 0)
        amount = F.format_string("%.2f", F.round(F.col(f"_{rate}") * F.col(f"_{kwh}"), 2))
        updates[cost] = F.when(missing & known, _field(amount, COMPUTED, -1)).otherwise(F.col(cost))
        notes.append(F.when(missing & known, F.concat(F.lit(f"{cost} computed: "), amount)))
    return _without_numbers(_note(numbers, notes).withColumns(updates), names)


def heal_totals(df: DataFrame) -> DataFrame:
    """VAT far off its rate is replaced, missing VAT and a missing total are computed."""
    names = ["subtotal", "vat_rate", "vat_amount", "total_incl_vat"]
    numbers = _with_numbers(df, names)
    net, rate, vat = F.col("_subtotal"), F.col("_vat_rate"), F.col("_vat_amount")
    expected = F.when((rate > 0) & (rate <= VAT_MAX), F.round(net * rate / 100, 2))
    steps = numbers.withColumn("_expected", expected)
    expected = F.col("_expected")
    wrong = (expected > 0) & vat.isNotNull() & (F.abs(expected - vat) / expected > 1.0)
    absent = expected.isNotNull() & vat.isNull()
    steps = steps.withColumn("_fixed", F.when(wrong, "corrected").when(absent, "computed"))
    steps = steps.withColumn("_vat", F.when(F.col("_fixed").isNotNull(), expected).otherwise(vat))
    total = F.round(net + F.col("_vat"), 2)
    add_total = F.col("_total_incl_vat").isNull() & total.isNotNull()
    vat_text, total_text = F.format_string("%.2f", expected), F.format_string("%.2f", total)
    notes = [
        F.when(F.col("_fixed").isNotNull(), F.concat(F.lit("vat_amount "), F.col("_fixed"), F.lit(": "), vat_text)),
        F.when(add_total, F.concat(F.lit("total_incl_vat computed: "), total_text)),
    ]
    level = F.when(F.col("_fixed") == "corrected", CORRECTED).otherwise(COMPUTED)
    healed = _note(steps, notes).withColumns({
        "vat_amount": F.when(F.col("_fixed").isNotNull(), _field(vat_text, level, -1)).otherwise(F.col("vat_amount")),
        "total_incl_vat": F.when(add_total, _field(total_text, COMPUTED, -1)).otherwise(F.col("total_incl_vat")),
    })
    return _without_numbers(healed, names).drop("_expected", "_fixed", "_vat")


# ---------------------------------------------------------------- validation and confidence

# Fields expected per bill type, and fields that point to a type.
FIELD_PROFILES = {
    "electricity": ["mprn", "account_number", "billing_period", "day_kwh", "day_rate", "standing_charge", "subtotal",
                    "vat_rate", "vat_amount", "total_incl_vat"],
    "gas": ["gprn", "account_number", "billing_period", "subtotal", "vat_rate", "vat_amount", "total_incl_vat"],
    "fuel": ["invoice_number", "invoice_date", "litres", "unit_price", "subtotal", "vat_rate", "vat_amount",
             "total_incl_vat"],
}
TYPE_SIGNALS = {
    "electricity": ["mprn", "day_kwh", "day_rate", "night_kwh", "night_rate"],
    "gas": ["gprn"],
    "fuel": ["litres", "unit_price", "invoice_number"],
}
TOTAL_TOLERANCE, VAT_TOLERANCE, VAT_TOLERANCE_SHARE = 0.02, 0.05, 0.01
TOTAL_LIMIT, KWH_LIMIT, STANDING_LIMIT = 100_000, 20_000, 500
RATE_RANGE, COST_RATIO = (0.01, 1.0), (0.5, 2.0)
PLAUSIBILITY = (
    [f"{f}_range" for f in RATE_FIELDS] + [f"{k}_range" for _, _, k in TRIPLETS]
    + [f"{c}_consistency" for c, _, _ in TRIPLETS] + ["standing_charge_range"]
)
ACCEPT, REVIEW = 0.85, 0.60


def validate_fields(df: DataFrame) -> DataFrame:
    """Add `checks ARRAY<STRUCT<name, passed>>`: only checks whose inputs are known take part."""
    names = ["subtotal", "vat_rate", "vat_amount", "total_incl_vat", "standing_charge",
             *[n for t in TRIPLETS for n in t]]
    numbers = _with_numbers(df, names)
    n = {f: F.col(f"_{f}") for f in names}
    net, rate, vat, total = n["subtotal"], n["vat_rate"], n["vat_amount"], n["total_incl_vat"]
    mprn = F.replace(value_of("mprn"), F.lit(" "), F.lit(""))

    def check(name: str, needed: Column, passed: Column) -> Column:
        return F.when(needed, F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed")))

    checks = [
        check("totals_crosscheck", total.isNotNull(), F.abs(net + vat - total) <= TOTAL_TOLERANCE),
        check("vat_math", net.isNotNull() & rate.isNotNull() & vat.isNotNull(),
              F.abs(net * rate / 100 - vat) <= F.greatest(F.lit(VAT_TOLERANCE), net * VAT_TOLERANCE_SHARE)),
        check("mprn_format", mprn.isNotNull(), mprn.rlike(r"^10\d{9}$")),
        check("total_reasonable", total.isNotNull(), (total >= 0) & (total < TOTAL_LIMIT)),
        check("vat_rate_range", rate.isNotNull(), rate.between(0, VAT_MAX)),
        *[check(f"{f}_range", n[f].isNotNull(), n[f].between(*RATE_RANGE)) for f in RATE_FIELDS],
        *[check(f"{k}_range", n[k].isNotNull(), n[k].between(0, KWH_LIMIT)) for _, _, k in TRIPLETS],
        *[check(f"{c}_consistency", (n[c] > 0) & (n[r] > 0) & (n[k] > 0), (n[r] * n[k] / n[c]).between(*COST_RATIO))
          for c, r, k in TRIPLETS],
        check("standing_charge_range", n["standing_charge"].isNotNull(), n["standing_charge"].between(0.01, STANDING_LIMIT)),
    ]
    return _without_numbers(numbers.withColumn("checks", F.filter(F.array(*checks), lambda c: c.isNotNull())), names)


def check_rows(validated: DataFrame, key: str = "bill_id") -> DataFrame:
    """(key, name, passed), one row per check."""
    return validated.select(key, F.inline_outer("checks")).filter(F.col("name").isNotNull())


def bill_type_of(provider: Column) -> Column:
    entries = [F.lit(x) for pair in R.PROVIDER_BILL_TYPE.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), provider)


def infer_bill_type() -> Column:
    """Type with the most signal fields; ties and no signal go to the type with the best covered profile."""
    signals = {t: found(fs) for t, fs in TYPE_SIGNALS.items()}
    top = F.greatest(*signals.values())
    winners = F.filter(F.array(*[F.when(s == top, t) for t, s in signals.items()]), lambda t: t.isNotNull())
    covered = F.array(*[
        F.struct((found(fs) / len(fs)).alias("share"), F.lit(-i).alias("rank"), F.lit(t).alias("type"))
        for i, (t, fs) in enumerate(FIELD_PROFILES.items())
    ])
    return F.when((top > 0) & (F.size(winners) == 1), F.get(winners, F.lit(0))).otherwise(F.array_max(covered)["type"])


def score_confidence(df: DataFrame, provider: str = "provider_name", ocr: str | None = None) -> DataFrame:
    """Add bill type, field coverage, check pass rate, score and band.

    Score: 0.4 coverage, 0.4 pass rate (0.5 without checks), 0.2 reading quality (0.5 when not read by OCR).
    A failed plausibility check keeps a bill out of the top band.
    """
    typed = df.withColumn("bill_type", F.coalesce(bill_type_of(F.col(provider)), infer_bill_type()))
    hits, size = F.lit(0), F.lit(1)
    for name, fields in FIELD_PROFILES.items():
        hits = F.when(F.col("bill_type") == name, found(fields)).otherwise(hits)
        size = F.when(F.col("bill_type") == name, len(fields)).otherwise(size)
    passed = F.size(F.filter("checks", lambda c: c["passed"]))
    implausible = F.exists("checks", lambda c: ~c["passed"] & c["name"].isin(PLAUSIBILITY))
    quality = F.lit(0.5)
    if ocr is not None:
        quality = F.when(F.col(ocr).isNotNull(), F.least(F.col(ocr) / 100, F.lit(1.0))).otherwise(0.5)
    score = F.col("score")
    return (
        typed.withColumn("fields_found", hits)
        .withColumn("expected_fields", size)
        .withColumn("field_coverage", F.col("fields_found") / F.col("expected_fields"))
        .withColumn("pass_rate", F.coalesce(F.try_divide(passed, F.size("checks")), F.lit(0.5)))
        .withColumn("score", F.col("field_coverage") * 0.4 + F.col("pass_rate") * 0.4 + quality * 0.2)
        .withColumn("band", F.when((score >= ACCEPT) & ~implausible, "accept")
                    .when(score >= REVIEW, "accept_with_review").otherwise("escalate"))
    )


# ---------------------------------------------------------------- merging sources

PREFERRED_EXTERNAL = ["provider", "customer_name", "supply_address", "billing_period", "invoice_date"]


def same_value(a: Column, b: Column, words: bool = True) -> Column:
    """Equal texts or numbers within a cent, commas and a leading sign aside: $ between records, any between word tables."""
    signs = r"^\$+" if words else "^[€$£]+"

    def plain(v: Column) -> Column:
        return F.trim(F.regexp_replace(F.replace(F.trim(v), F.lit(","), F.lit("")), signs, ""))

    x, y = plain(a), plain(b)
    both = to_number(x).isNotNull() & to_number(y).isNotNull()
    texts = (F.lower(x) == F.lower(y)) if words else (x == y)
    return (x == y) | F.when(both, F.abs(to_number(x) - to_number(y)) < 0.01).otherwise(texts)


def agreed_field(first: Column, second: Column) -> Column:
    """First value, higher confidence plus 0.1."""
    return F.struct(
        first["value"].alias("value"),
        F.least(F.greatest(first["confidence"], second["confidence"]) + 0.1, F.lit(1.0)).alias("confidence"),
        first["pattern_index"].alias("pattern_index"),
    )


def merge_field(first: Column, second: Column, prefer_second: Column, words: bool = True) -> Column:
    """One source: take it.  Agreement: see `agreed_field`.  Conflict: as preferred."""
    return (
        F.when(first.isNull(), second)
        .when(second.isNull(), first)
        .when(same_value(first["value"], second["value"], words), agreed_field(first, second))
        .when(prefer_second, second)
        .otherwise(first)
    )


def merged_fields(first: Callable[[str], Column], second: Callable[[str], Column], prefer_second: Callable[[str], Column],
                  words: bool = True) -> Column:
    """MAP of every known field to what `merge_field` makes of its two sources: one expression runs over all fields."""
    sources = F.array(*[F.struct(F.lit(f).alias("field"), first(f).cast(FIELD).alias("first"),
                                 second(f).cast(FIELD).alias("second"), prefer_second(f).alias("prefer")) for f in FIELDS])
    return F.map_from_entries(F.transform(sources, lambda e: F.struct(
        e["field"].alias("field"), merge_field(e["first"], e["second"], e["prefer"], words).alias("merged"))))


def from_map(column: str) -> dict[str, Column]:
    """Field columns from a map of fields."""
    return {f: F.try_element_at(column, F.lit(f)) for f in FIELDS}


def reconcile(existing: DataFrame, external: DataFrame, prefer_external: bool = False, key: str = "bill_id") -> DataFrame:
    """Merge two tables of long field rows; `prefer_external` decides every conflict for the external source."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, "field_name", F.struct("value", "confidence", "pattern_index").alias(name))

    joined = packed(existing, "a").join(packed(external, "b"), [key, "field_name"], "full_outer")
    prefer = F.lit(True) if prefer_external else F.col("field_name").isin(PREFERRED_EXTERNAL)
    return joined.select(key, "field_name", merge_field(F.col("a"), F.col("b"), prefer).alias("m")).select(
        key, "field_name", "m.*"
    )


def reconcile_bills(existing: DataFrame, external: DataFrame, prefer_external: bool | None = False,
                    key: str = "bill_id", how: str = "full_outer") -> DataFrame:
    """As `reconcile`, for two tables of one row per bill with field columns: one join by bill, merged column by column.

    With `prefer_external` None each bill gives two rows, decided for either side as `preferred` names it. Values are
    compared once for both, and only where both sides have one. With `how` "left" bills of `external` alone are left out.
    """
    ours = existing.select(key, *[F.col(f).cast(FIELD).alias(f"_a_{f}") for f in FIELDS])
    theirs = external.select(key, *[F.col(f).cast(FIELD).alias(f"_b_{f}") for f in FIELDS])
    pairs = F.array(*[F.when(F.col(f"_a_{f}").isNotNull() & F.col(f"_b_{f}").isNotNull(),
                             F.struct(F.col(f"_a_{f}").alias("a"), F.col(f"_b_{f}").alias("b"))) for f in FIELDS])
    agreed = F.transform(pairs, lambda e: F.when(e.isNotNull() & same_value(e["a"]["value"], e["b"]["value"]),
                                                 agreed_field(e["a"], e["b"])))
    joined = ours.join(by_merge(theirs), key, how).withColumn("_agreed", agreed)
    keys, chosen = [key], F.lit(prefer_external)
    if prefer_external is None:
        joined = joined.withColumn("preferred", F.explode(F.array(F.lit("own"), F.lit("external"))))
        keys, chosen = ["preferred", key], F.col("preferred") == "external"

    def merged(i: int, f: str) -> Column:
        a, b, same = F.col(f"_a_{f}"), F.col(f"_b_{f}"), F.get("_agreed", F.lit(i))
        prefer = F.lit(True) if f in PREFERRED_EXTERNAL else chosen
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.coalesce(same, F.when(prefer, b).otherwise(a)))

    return joined.select(*keys, *[merged(i, f).alias(f) for i, f in enumerate(FIELDS)])


EXTERNAL_RECORD = (
    "provider string, invoice_number string, account_number string, mprn string, gprn string, invoice_date string, "
    "billing_period string, line_items array<struct<description:string,quantity:double,unit:string,unit_price:double,"
    "line_total:double>>, subtotal double, vat_rate double, vat_amount double, total_incl_vat double, "
    "customer_name string, supply_address string"
)
EXTERNAL_CONFIDENCE = 0.75


def external_fields(records: DataFrame, json: str = "json") -> DataFrame:
    """Field columns from structured JSON records of another extractor; later line items win."""
    parsed = records.withColumn("r", F.from_json(F.col(json), EXTERNAL_RECORD))
    r = F.col("r")

    def kind(item: Column) -> Column:
        text = F.lower(item["description"])
        energy = text.contains("energy")
        return (
            F.when(text.contains("day") & energy, "day").when(text.contains("night") & energy, "night")
            .when(text.contains("standing"), "standing").when(text.contains("pso"), "pso")
            .when(text.rlike("kerosene|oil|fuel|litre"), "fuel")
        )

    items = F.transform(F.coalesce(r["line_items"], F.array().cast("array<struct<description:string,quantity:double,"
                        "unit:string,unit_price:double,line_total:double>>")),
                        lambda i: F.struct(kind(i).alias("kind"), i.alias("i")))
    parsed = parsed.withColumn("_items", items)

    def last(of: str, part: str) -> Column:
        known = F.filter("_items", lambda x: (x["kind"] == of) & x["i"][part].isNotNull())
        return F.try_element_at(known, F.lit(-1))["i"][part].cast("string")

    def standing() -> Column:
        parts = ("quantity", "unit_price", "line_total")
        texts = F.transform(F.filter("_items", lambda x: x["kind"] == "standing"), lambda x: F.array(
            *[F.coalesce(x["i"][p].cast("string"), F.lit("")) for p in parts]))
        known = F.filter(texts, lambda t: F.array_join(t, "") != "")
        return F.array_join(F.try_element_at(known, F.lit(-1)), " - ")

    texts = {f: F.trim(r[f]) for f in ("provider", "invoice_number", "account_number", "mprn", "gprn", "invoice_date",
                                       "billing_period", "customer_name", "supply_address")}
    numbers = {f: r[f].cast("string") for f in ("subtotal", "vat_rate", "vat_amount", "total_incl_vat")}
    from_items = {
        "day_kwh": last("day", "quantity"), "day_rate": last("day", "unit_price"), "day_cost": last("day", "line_total"),
        "night_kwh": last("night", "quantity"), "night_rate": last("night", "unit_price"),
        "standing_charge": standing(), "pso_levy": last("pso", "line_total"),
        "litres": last("fuel", "quantity"), "unit_price": last("fuel", "unit_price"),
    }
    values = {**texts, **numbers, **from_items}
    # The texts are a step of their own, so that each is made once and the fields need no function over arrays.
    texts = staged(parsed, {"_texts": F.struct(*[v.alias(f) for f, v in values.items()])}).drop("r", "_items")
    text = {f: F.col("_texts")[f] for f in values}
    fields = {f: F.when(text[f] != "", _field(text[f], EXTERNAL_CONFIDENCE, -1)).cast(FIELD) if f in values else _no_field()
              for f in FIELDS}
    return texts.withColumns(fields).drop("_texts")


def known_provider(name: Column) -> Column:
    """Canonical provider for a name in any case, the trimmed name when not known, 'unknown' when blank."""
    entries = [F.lit(x) for p in R.PROVIDER_BILL_TYPE for x in (p.lower(), p)]
    trimmed = F.trim(name)
    return F.when(trimmed != "", F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(trimmed)), trimmed)).otherwise(
        UNKNOWN)


# ---------------------------------------------------------------- building bills


def _item(description: str, total: Column, quantity: Column | None = None, unit: str | None = None,
          price: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.when(total.isNotNull(), F.struct(
        F.lit(description).alias("description"), total.alias("line_total"),
        (none if quantity is None else quantity).alias("quantity"), F.lit(unit).cast("string").alias("unit"),
        (none if price is None else price).alias("unit_price"), none.alias("vat_rate"), none.alias("vat_amount"),
    ))


def build_bills(df: DataFrame, include_peak: bool = False) -> DataFrame:
    """Nested bills with line items from the field columns.

    Peak energy is left out unless `include_peak`, as its cost then joins the flat totals.
    """
    names = ["subtotal", "vat_rate", "vat_amount", "total_incl_vat", "pso_levy", "litres", "unit_price",
             *[n for t in TRIPLETS for n in t]]
    numbers = _with_numbers(df, names)
    n = {f: F.col(f"_{f}") for f in names}
    numbers = numbers.withColumn("_sc", F.split(value_of("standing_charge"), " - "))
    three = F.size("_sc") == 3
    part = [safe_float(F.get("_sc", F.lit(i))) for i in range(3)]
    labels = {"day": "Day Energy", "night": "Night Energy", "peak": "Peak Energy"}
    energy = []
    for kind in ("day", "night", "peak") if include_peak else ("day", "night"):
        kwh, rate = n[f"{kind}_kwh"], n[f"{kind}_rate"]
        energy.append(_item(labels[kind], F.coalesce(n[f"{kind}_cost"], F.round(kwh * rate, 2)), kwh, "kWh", rate))
    items = F.array(
        *energy,
        _item("Standing Charge", F.when(three, part[2]).otherwise(safe_float(value_of("standing_charge"))),
              F.when(three, part[0]), "days", F.when(three, part[1])),
        _item("PSO Levy", n["pso_levy"]),
        F.when(n["litres"].isNotNull(), _item("Kerosene", n["subtotal"], n["litres"], "litres", n["unit_price"])),
    )
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.concat(F.lit("Check failed: "), c["name"]))
    review = F.when(F.col("band") == "escalate", F.array(F.lit("Low confidence, review by hand"))).otherwise(
        F.array().cast("array<string>"))
    earlier = F.col("warnings") if "warnings" in df.columns else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    return numbers.select(
        "bill_id", F.col("provider_name").alias("provider"),
        *[value_of(f).alias(f) for f in ("invoice_number", "account_number", "mprn", "gprn", "invoice_date",
                                          "billing_period")],
        none.alias("due_date"),
        F.filter(items, lambda i: i.isNotNull()).alias("line_items"),
        n["subtotal"].alias("subtotal"), n["vat_amount"].alias("vat_amount"), n["vat_rate"].alias("vat_rate"),
        n["total_incl_vat"].alias("total_incl_vat"), none.alias("fuel_type"),
        "extraction_method", F.col("score").alias("confidence_score"), F.col("text").alias("raw_text"),
        F.concat(earlier, failed, review).alias("warnings"),
    )

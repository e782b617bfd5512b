"""Fields from OCR word tables: find printed labels, then the nearest value of the right kind.

words(doc_id, page_num, block_num, line_num, word_num, left, top, width, height, conf, text)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter, ne
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wattmill import extraction_rules as R
from wattmill.functions.steps import staged
from wattmill.operators import extract as ex

LINE = ["doc_id", "page_num", "block_num", "line_num"]
# Common misreadings, replaced in this order.
MISREADINGS = [("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("rn", "m"), ("cl", "d"), ("ii", "u")]
MIN_FUZZY_LENGTH, MIN_CONF = 3, 30
RIGHT_REACH, RIGHT_WEIGHT, Y_TOLERANCE, BELOW_REACH, LEFT_REACH = 10, 0.8, 1.5, 8, 3
BASE, SPECIFIC, NEAR, RIGHT_BONUS, OCR_SHARE = 0.70, (0.10, 0.05), ((50, 0.05), (100, 0.02)), 0.05, 0.1
AMOUNT = r"^\d[\d,]*\.\d{2}$"
MONEY_CLEAN = ["subtotal", "vat_amount", "total_incl_vat", "standing_charge", "pso_levy", "day_rate", "night_rate"]
CURRENCY = "^[€$£]+"


def clean_words(words: DataFrame) -> DataFrame:
    """Drop entries without text."""
    text = F.trim("text")
    return words.filter((F.col("conf") != -1) & (text != "")).withColumn("text", text)


def document_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.avg("conf").alias("avg_ocr_confidence"))


def text_lines(words: DataFrame) -> DataFrame:
    """One row per printed line, its words in reading order.  A line holds few words."""
    word = F.struct("left", "word_num", "text", "top", "width", "height", "conf")
    return words.groupBy(*LINE).agg(F.sort_array(F.collect_list(word)).alias("words"))


# ---------------------------------------------------------------- labels


def _bare(word: str) -> str:
    return re.sub(r"^[^a-z0-9]+|[^a-z0-9%]+$", "", word.lower())


_LABELS = {label: [_bare(w) for w in label.split()] for labels in R.ANCHOR_LABELS.values() for label in labels}
_LABEL_WORDS = sorted({w for words in _LABELS.values() for w in words})


_EDGES = re.compile("^[^a-z0-9]+|[^a-z0-9%]+$")
_LABELS_FROM = {first: [(label, words) for label, words in _LABELS.items() if words[0] == first]
                for first in {words[0] for words in _LABELS.values()}}
_FIRST_WORDS = frozenset(_LABELS_FROM)
_USES = {label: [(f, labels.index(label)) for f, labels in R.ANCHOR_LABELS.items() if label in labels] for label in _LABELS}
CACHED = 1 << 16  # words a task remembers


@lru_cache(CACHED)
def label_words_like(word: str) -> frozenset[str]:
    """Label words a printed word can stand for: equal, equal after undoing misreadings, or one letter off."""
    bare = fixed = _EDGES.sub("", word.lower())
    for wrong, right in MISREADINGS:
        fixed = fixed.replace(wrong, right)
    return frozenset(
        w for w in _LABEL_WORDS
        if w in (bare, fixed) or (len(w) == len(bare) >= MIN_FUZZY_LENGTH and sum(map(ne, w, bare)) == 1)
    )


def _labels_of(words: list[str]) -> list[dict]:
    """Every label on a line with its first place and its number of words."""
    likes = list(map(label_words_like, words))
    seen = frozenset().union(*likes)
    hits = []
    for first in seen & _FIRST_WORDS:
        for label, parts in _LABELS_FROM[first]:
            if seen.issuperset(parts):
                start = next((i for i in range(len(words) - len(parts) + 1)
                              if all(part in likes[i + j] for j, part in enumerate(parts))), None)
                if start is not None:
                    hits.append({"label": label, "start": start, "span": len(parts)})
    return hits


@F.arrow_udf(T.ArrayType(T.StructType().add("label", T.StringType()).add("start", T.IntegerType()).add("span", T.IntegerType())))
def _line_labels(lines: pa.Array) -> pa.Array:
    return pa.array([_labels_of(words) for words in lines.to_pylist()],
                    pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("span", pa.int32())])))


def find_anchors(lines: DataFrame) -> DataFrame:
    """Every label on every line, at its first place on the line, with the box around its words."""
    texts = F.transform("words", lambda w: w["text"])
    uses = F.create_map(*[
        x for label in _LABELS for x in (
            F.lit(label),
            F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(i).alias("specificity")) for f, i in _USES[label]]),
        )
    ])
    placed = staged(lines, {"hits": _line_labels(texts)}).select(*LINE, "words", F.inline("hits")).withColumn(
        "part", F.slice("words", F.col("start") + 1, F.col("span"))
    )
    left = F.array_min(F.transform("part", lambda w: w["left"]))
    top = F.array_min(F.transform("part", lambda w: w["top"]))
    right = F.array_max(F.transform("part", lambda w: w["left"] + w["width"]))
    bottom = F.array_max(F.transform("part", lambda w: w["top"] + w["height"]))
    boxed = placed.select(
        *LINE, "label", "start", "span", left.alias("a_left"), top.alias("a_top"), (right - left).alias("a_width"),
        (bottom - top).alias("a_height"), F.explode(uses[F.col("label")]).alias("use"),
    )
    return boxed.select("*", "use.*").drop("use")


def best_anchors(anchors: DataFrame) -> DataFrame:
    """Per document and field: most specific label, then earliest page, then lowest on the page."""
    order = F.struct("specificity", "page_num", (-F.col("a_top")).alias("up"), "block_num", "line_num")
    keep = ["page_num", "block_num", "line_num", "label", "start", "span", "specificity", "a_left", "a_top", "a_width",
            "a_height"]
    return anchors.groupBy("doc_id", "field_name").agg(F.min_by(F.struct(*keep), order).alias("a")).select(
        "doc_id", "field_name", "a.*"
    )


# ---------------------------------------------------------------- values


# Kinds of value of a field: what is taken out of the word first, and the pattern of the rest.
_OWN_KINDS = {
    "mprn": (" ", r"(?a)^10\d{9}$"),
    "vat_rate": ("", r"(?a)^\d{1,2}(?:\.\d+)?%?$"),
    "vat_amount": ("", "(?a)" + AMOUNT),
    "day_kwh": (",", r"(?a)^\d{2,}$"),
    "night_kwh": (",", r"(?a)^\d{2,}$"),
    "account_number": (" /-", r"^\d\w{3,19}$"),
    "invoice_number": ("", r"^\d[\w\-/]{3,19}$"),
    "billing_period": ("", r"(?a)\d"),
    "gprn": (" ", r"(?a)^\d{7}$"),
}
_KINDS = {
    name: (str.maketrans("", "", out), re.compile(pattern)) for name, (out, pattern) in {
        **{f: ("", "^(?:" + "|".join(f"(?:{R.VALUE_TYPE_PATTERNS[t]})" for t in types) + ")")
           for f, types in R.FIELD_VALUE_TYPES.items()},
        **_OWN_KINDS,
    }.items() if name in R.FIELD_VALUE_TYPES
}


@lru_cache(CACHED)
def fitting_fields(text: str) -> tuple[str, ...]:
    """Fields that a word is a possible value of."""
    clean = text.strip(" ").lstrip("€$£").strip(" ")
    return tuple(f for f, (out, pattern) in _KINDS.items() if pattern.search(clean.translate(out))) if clean else ()


class _Anchor(NamedTuple):
    """The best label of a field, with what a word's place is compared with."""

    order: tuple  # most specific label, then earliest page, then lowest on the page
    page: int
    line: tuple
    start: int
    end: int
    left: float
    right: float
    bottom: float
    middle: float
    most_off: float
    most_across: float
    most_aside: float
    most_down: float


def _anchors_of(lines: list[tuple]) -> dict[str, _Anchor]:
    """The best label of each field, as `best_anchors` chooses it."""
    best = {}
    for place, texts, words in lines:
        for hit in _labels_of(texts):
            start, end = hit["start"], hit["start"] + hit["span"]
            boxes = [(w[0], w[1], w[0] + w[2], w[1] + w[3]) for w in words[start:end]]
            left, top, right, bottom = *map(min, zip(*(b[:2] for b in boxes))), *map(max, zip(*(b[2:] for b in boxes)))
            if any(x != x for b in boxes for x in b):
                continue
            width, height = right - left, bottom - top
            for field, specificity in _USES[hit["label"]]:
                order = (specificity, place[0], -top, *place[1:])
                if field not in best or order < best[field].order:
                    best[field] = _Anchor(order, place[0], place, start, end, left, right, bottom, top + height / 2, height * Y_TOLERANCE,
                                          width * RIGHT_REACH, width * LEFT_REACH, height * BELOW_REACH)
    return best


def _distance(left: float, top: float, width: float, height: float, a: _Anchor) -> tuple[float, str] | None:
    """How far a word is from a label it stands right of, or else below."""
    across = left - a.right
    if 0 < across <= a.most_across and abs(top + height / 2 - a.middle) < a.most_off:
        return across * RIGHT_WEIGHT, "right"
    down = top - a.bottom
    if 0 < down <= a.most_down and (left >= a.left or a.left - left < a.most_aside or left + width > a.left):
        return down, "below"
    return None


_AMOUNT = re.compile(AMOUNT, re.ASCII)
_MONEY = {f for f, types in R.FIELD_VALUE_TYPES.items() if "monetary" in types}


def _values_of(lines: list[tuple]) -> list[dict] | None:
    """Closest fitting word right of, or below, the best label of each field; None without any label.

    A line is its place (page, block, line), its texts, and (left, top, width, height, conf, word number) of its words; a
    word without a place (not a number) is neither label nor value.
    """
    lines = [x for x in lines if None not in x[0]]
    anchors = _anchors_of(lines)
    best, amounts = {}, {}
    for place, texts, words in lines if anchors else ():
        for pos, (text, (left, top, width, height, conf, number)) in enumerate(zip(texts, words)):
            if not conf >= MIN_CONF:
                continue
            for field in fitting_fields(text):
                a = anchors.get(field)
                if a is None or a.page != place[0] or (a.line == place and a.start <= pos < a.end):
                    continue
                hit = _distance(left, top, width, height, a)
                if hit is None:
                    continue
                found = (hit[0], *place[1:], number), text, *hit, a.order[0]
                if field not in best or found[0] < best[field][0]:
                    best[field] = found
                if field in _MONEY and (field not in amounts or found[0] < amounts[field][0]) and _AMOUNT.search(text.strip(" ")):
                    amounts[field] = found
    # A lone currency sign stands for the next amount.
    chosen = {f: amounts[f] if f in amounts and v[1].strip(" ") in ("€", "$", "£", "EUR") else v for f, v in best.items()}
    return [dict(zip(_VALUE, (f, *v[1:]))) for f, v in chosen.items()] if anchors else None


_VALUE = ("field_name", "text", "distance", "direction", "specificity")
_VALUES = "array<struct<field_name:string,text:string,distance:double,direction:string,specificity:int>>"
_WORD = ["left", "top", "width", "height", "conf", "word_num"]


def _listed(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _read(words: pa.Table) -> list[tuple]:
    """A row of every document of words in reading order: its text, mean confidence and values."""
    texts = words["text"].to_pylist()
    places = list(zip(*(_listed(words[c]) for c in LINE[1:])))
    boxes = list(zip(*(words[c].cast(pa.float64()).to_numpy().tolist() for c in _WORD)))
    rows = []
    for doc_id, of_doc in groupby(enumerate(words["doc_id"].to_pylist()), itemgetter(1)):
        lines = []
        for place, of_line in groupby((at for at, _ in of_doc), places.__getitem__):
            at = list(of_line)
            lines.append((place, texts[at[0]:at[-1] + 1], boxes[at[0]:at[-1] + 1]))
        known = [w[4] for _, _, ws in lines for w in ws if w[4] == w[4]]
        rows.append((doc_id, "\n".join(" ".join(x[1]) for x in lines), sum(known) / len(known) if known else None, _values_of(lines)))
    return rows


def documents(words: DataFrame) -> DataFrame:
    """doc_id, ocr_text (lines in page, block and line order), avg_ocr_confidence and `values` of every document.

    `values` has at most one entry per field, in no order: the closest fitting words; it is null without any label. Words
    are shuffled once, by document, and sorted by Spark; a task keeps the words of one document between batches.
    """
    key = words.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", key).add("ocr_text", "string").add("avg_ocr_confidence", "double").add(
        "values", T.ArrayType(T.StructType.fromDDL(_VALUES[len("array<struct<"):-2])))
    kinds = pa.schema([("doc_id", to_arrow_type(key)), ("ocr_text", pa.string()), ("avg_ocr_confidence", pa.float64()),
                       ("values", to_arrow_type(schema["values"].dataType))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*_read(table)), kinds)], schema=kinds)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ids = held["doc_id"]
            if len(ids) and ids[0] != ids[-1]:
                last = pc.index(ids, ids[-1]).as_py()
                yield made(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield made(held)

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.filter("doc_id is not null").select(*LINE, "text", *_WORD).repartition(parts, "doc_id")
    return rows.sortWithinPartitions(*LINE, "left", "word_num", "text").mapInArrow(read, schema)


def clean_value(text: Column, field: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.trim(text), CURRENCY, ""))
    return (
        F.when(field == "mprn", F.replace(plain, F.lit(" "), F.lit("")))
        .when(field == "vat_rate", F.trim(F.regexp_replace(plain, "%+$", "")))
        .when(field.isin(MONEY_CLEAN), F.replace(plain, F.lit(","), F.lit("")))
        .otherwise(plain)
    )


def match_confidence(v: Column) -> Column:
    """Of a value: base plus specific label, closeness, rightward position and reading quality, at most 1."""
    specific = F.when(v["specificity"] == 0, SPECIFIC[0]).when(v["specificity"] == 1, SPECIFIC[1]).otherwise(0.0)
    close = F.when(v["distance"] < NEAR[0][0], NEAR[0][1]).when(v["distance"] < NEAR[1][0], NEAR[1][1]).otherwise(0.0)
    right = F.when(v["direction"] == "right", RIGHT_BONUS).otherwise(0.0)
    quality = F.least(F.col("avg_ocr_confidence") / 100, F.lit(1.0)) * OCR_SHARE
    return F.least(F.lit(BASE) + specific + close + right + quality, F.lit(1.0))


def spatial_fields(words: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, pattern_index) by position alone."""
    values = documents(words).select("doc_id", "avg_ocr_confidence", F.explode("values").alias("v"))
    v = F.col("v")
    return values.select(
        "doc_id", v["field_name"].alias("field_name"), clean_value(v["text"], v["field_name"]).alias("value"),
        match_confidence(v).alias("confidence"), F.lit(0).alias("pattern_index"),
    )


def extract_spatial(words: DataFrame) -> DataFrame:
    """Field columns per document: by position, merged with the universal patterns on the rebuilt text.

    Agreement raises confidence, patterns win conflicts; documents without any label give no fields.
    """
    by_field = F.map_from_entries(F.transform("values", lambda v: F.struct(
        v["field_name"], F.struct(clean_value(v["text"], v["field_name"]).alias("value"), match_confidence(v).alias("confidence"),
                                  F.lit(0).alias("pattern_index")).cast(ex.FIELD))))
    joined = documents(words).select("doc_id", "ocr_text", "avg_ocr_confidence", F.when(F.col("values").isNotNull(), True).alias("has_labels"),
                         by_field.alias("m"))
    known = ex.detect_provider(joined, "ocr_text").drop("matched_keyword", "is_known")
    fixed = staged(known, {"fixed": ex.clean_text(F.col("ocr_text"), F.col("provider"))})
    read = ex.universal_fields(fixed, "fixed", F.col("has_labels")).withColumnsRenamed(
        {"provider": "detected_provider", "x": "p"})
    both = ex.merged_fields(lambda f: F.try_element_at("m", F.lit(f)), lambda f: F.col("p")[f], lambda f: F.lit(True), False)
    merged = staged(read, {"_merged": both}).withColumns(ex.from_map("_merged")).drop("_merged", "m", "p", "fixed")
    return (
        merged.withColumn("field_count", ex.found())
        .withColumn("hit_rate", F.col("field_count") / len(R.ANCHOR_LABELS))
        .withColumn("warnings", F.filter(
            F.array(F.when(F.col("has_labels").isNull(), "No labels found")), lambda w: w.isNotNull()))
        .drop("has_labels")
    )

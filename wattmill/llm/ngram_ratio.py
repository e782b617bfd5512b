"""Quality rules with a hashed n-gram likelihood ratio between trusted documents and the whole corpus.

Two multinomials over hashed n-grams of SIZE bytes are counted: one over the trusted documents (labelled quality 1 and
not toxic), one over all documents. The n-grams are hashed into ROOT buckets per square root of the corpus' bytes, as
different n-grams grow about as the square root of a corpus; so the counted table grows with the input, and it stays
small enough to be broadcast: 4 bytes a bucket, 640 MB for 100 TB of texts (spark.driver.maxResultSize must admit twice
that). The verdict of a document is the mean over its n-grams of log(trusted / raw), both smoothed towards the share of
the trusted ones, against a fixed threshold: a text as the trusted ones has about 0, a text of n-grams that trusted
documents hardly use is far below.

The texts are read twice where they lie, for counting and for judging, and never shuffled; a task sends each bucket once.

Null and empty texts have no words and fail the base rules; a text without n-grams has ratio 0. Without trusted
documents all ratios are 0 and the base rules alone decide. Repeated rows are judged alike and all counted; rows with a
null doc_id are raw text. A doc_id with several labels is trusted only if all its labels are. Extra columns are kept by
`judged`, and those named like its own are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from wattmill.llm.common import fits, in_small_batches, read_table, written
from wattmill.llm.grams import added, hashed_grams
from wattmill.llm.word_codes import run_codes, word_codes

NAME = "op8_ngram_ratio"
SQL = None  # needs the counts of hashed n-grams
SIZE = 4  # bytes of an n-gram
ROOT = 16  # buckets per square root of the corpus' bytes
SMOOTHING = 1.0
MERGE = 1 << 20  # n-grams of texts that are held before they are merged
MOST_HELD = 1 << 23  # buckets that a task holds before it sends them
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "log_ratio double, base_failed boolean, kept boolean")
THRESHOLD = float(np.log(0.5))  # n-grams on average half as likely among trusted documents
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RUN = 5
MOST_BROADCAST = 2_000_000  # labelled doc_ids that are broadcast
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def repeated_words(codes: np.ndarray) -> int:
    """Words inside runs of RUN words that occur twice or more in the text."""
    n = len(codes) - RUN + 1
    if n < 2:
        return 0
    runs = run_codes(codes, RUN)
    order = np.argsort(runs)
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    covered = np.zeros(len(codes) + 1, np.int64)
    covered[:n] += twice
    covered[RUN:RUN + n] -= twice
    return int((np.cumsum(covered) > 0).sum())


def base_counts(texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    for text, codes in zip(texts, word_codes([(t or "").encode() for t in texts])):
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        yield (len(codes), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
               len(lines) - len(set(lines)), repeated_words(codes))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter(
        "good and doc_id is not null").select(F.col("doc_id").alias("trusted_id"))


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, trusted), each bucket once per task and MERGE of them."""
    ids = trusted_ids(labels)
    ids = F.broadcast(ids) if fits(ids, MOST_BROADCAST) else ids
    marked = in_small_batches(docs.select("doc_id", "text")).join(
        ids, F.col("doc_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull())

    def sums(grams: list[np.ndarray], good: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        found, raw = np.unique(np.concatenate(grams), return_counts=True)
        trusted = np.zeros(len(found), np.int64)
        if good:
            some, n = np.unique(np.concatenate(good), return_counts=True)
            trusted[np.searchsorted(found, some)] = n
        return found, raw, trusted

    def sent(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x.astype(np.int64)) for x in part], ["bucket", "raw", "trusted"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        grams, good, held = [], [], 0
        for batch in batches:
            for text, trusted in zip(batch.column(0), batch.column(1).to_pylist()):
                for some in hashed_grams(text.as_py(), SIZE, buckets):
                    grams.append(some)
                    held += len(some)
                    if trusted:
                        good.append(some)
                    if held >= MERGE:
                        parts = [added([*parts, sums(grams, good)])]
                        grams, good, held = [], [], 0
                        if len(parts[0][0]) >= MOST_HELD:
                            yield sent(parts.pop())
        if grams:
            parts.append(sums(grams, good))
        if parts:
            yield sent(added(parts))

    return marked.mapInArrow(count, "bucket long, raw long, trusted long")


def ratio_table(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted / raw) of every bucket; all 0 without trusted documents."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(ROOT * math.sqrt(size)))
    table = np.zeros(buckets, np.float32)
    sums = written(bucket_counts(docs, labels, buckets).groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")), "ratio-counts")
    raw_all, trusted_all = sums.agg(F.sum("raw"), F.sum("trusted")).first()
    if not trusted_all:
        return table
    share = trusted_all / raw_all
    ratio = F.log((F.col("trusted") + SMOOTHING * share) / (F.col("raw") + SMOOTHING)) - math.log(share)
    known = sums.select(F.col("bucket").cast("int").alias("bucket"), ratio.cast("float").alias("ratio")).toArrow()
    table[known["bucket"].to_numpy()] = known["ratio"].to_numpy()
    return table


def with_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `__rules`: a struct of the base counts, the mean log ratio, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, labels))
    schema = StructType([*docs.schema.fields, StructField("__rules", _parse_datatype_string(FIELDS))])
    names, fields = docs.columns, [f.split()[0] for f in FIELDS.split(", ")]
    types, text_at = to_arrow_schema(schema), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            out = []
            texts = batch.column(text_at).to_pylist()
            for text, base in zip(texts, base_counts(texts)):
                found = [(ratios[g].sum(dtype=np.float64), len(g)) for g in hashed_grams(text, SIZE, len(ratios))]
                ratio = float(sum(x for x, _ in found) / sum(n for _, n in found)) if found else 0.0
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                out.append(dict(zip(fields, (*base, ratio, failed, not failed and ratio >= THRESHOLD))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, types.field("__rules").type)],
                                             names=[*names, "__rules"])

    return in_small_batches(docs).mapInArrow(judge, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the columns of FIELDS."""
    columns = [f.split()[0] for f in FIELDS.split(", ")]
    return with_rules(docs, labels).withColumns({c: F.col(f"__rules.{c}") for c in columns}).drop("__rules")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their own columns alone."""
    return with_rules(docs, labels).filter("__rules.kept").drop("__rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return judged(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_ratio")

"""Resampling by importance for a target distribution: hashed words, log gains and a Gumbel draw.

A feature is a run of 1 to `run` consecutive words, joined by one space; its bucket is its CRC-32 modulo the number of
buckets, found for all features of some texts at once by `position_crc`. Buckets are counted over all raw and over all
target texts. A bucket's gain is 1000 times the logarithm of its smoothed share among the target over that among the raw
texts, a document's weight the mean gain of its features; a Gumbel number from a hash of the doc_id is added, and the
documents with the highest sums are drawn.

One pass writes the buckets of every document, two bytes each. Counts are added up in the task, then by bucket, so the
driver reads one number per bucket. Ranks come from ranges of (score, doc_id, place in the table) with one running sum
over ranges; the place splits repeated rows, so no key stands in one task.

Null and empty texts have no features and weight 0; a null doc_id is hashed as an empty one and stands last among equal
scores; repeated rows are all ranked, in the order of the table; empty tables are counted as zeros. Further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.common import read_table, shuffle_width, written
from wattmill.llm.position_crc import span_crcs

NAME = "op12_importance"
BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE = 1 << 20  # bytes looked at together
ROWS = 512  # documents of a batch that are Python objects at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BLANK = np.uint8(32)


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of a long text that end where a word ends."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and IN_WORD[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def _joined_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of raw in lower case with one blank after each; where they start and end there, and began in raw."""
    data = LOWER[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(IN_WORD[data], prepend=False, append=False))
    begun, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(lengths + 1) - 1
    words = np.full(int(ends[-1]) + 1 if len(ends) else 0, BLANK)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = data[IN_WORD[data]]
    return words, ends - lengths, ends, begun


def _part_buckets(raw: bytes, stops: np.ndarray, buckets: int, run: int, carried: int = 0) -> list[np.ndarray]:
    """Buckets of each text of raw, which stop at `stops`; of runs that end after the first `carried` words."""
    words, starts, ends, begun = _joined_words(raw)
    text = np.searchsorted(stops, begun, side="right")
    found, owner = [], []
    for n in range(1, run + 1):
        last = np.arange(n - 1, len(starts))
        last = last[(text[last] == text[last - n + 1]) & (last >= carried)]
        found.append(span_crcs(words, starts[last - n + 1], ends[last]) % np.uint32(buckets))
        owner.append(text[last])
    found, owner = np.concatenate(found), np.concatenate(owner)
    if run > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(stops))))


def text_buckets(texts: Iterable[str | None], buckets: int = BUCKETS, run: int = RUN) -> Iterator[np.ndarray]:
    """The buckets of the features of each text; short texts are handled together, long ones in slices."""
    held: list[bytes] = []
    size = 0

    def together() -> list[np.ndarray]:
        return _part_buckets(b"\n".join(held), np.cumsum([len(t) + 1 for t in held]), buckets, run) if held else []

    for text in texts:
        raw = (text or "").encode()
        if size + len(raw) > SLICE:
            yield from together()
            held, size = [], 0
        if len(raw) <= SLICE:
            held.append(raw)
            size += len(raw)
            continue
        found, before = [], b""
        for part in _slices(raw):  # the last words of a slice go before the next one
            carried = min(run - 1, len(before.split()))
            whole = before + part
            found += _part_buckets(whole, np.array([len(whole) + 1]), buckets, run, carried)
            if run > 1:
                words, starts, _, _ = _joined_words(whole)
                before = words[starts[max(0, len(starts) - run + 1)]:].tobytes() if len(starts) else b""
        yield np.concatenate(found)
    yield from together()


def feature_table(docs: DataFrame, buckets: int, run: int) -> DataFrame:
    """doc_id, n_features, buckets (little-endian, four bytes above 65,536 buckets) and the row's place in the table."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            found = list(text_buckets(batch.column(1).to_pylist(), buckets, run))
            n = len(found)
            yield pa.record_batch([
                batch.column(0), pa.array([len(x) for x in found], pa.int64()),
                pa.array([x.astype(kind).tobytes() for x in found], pa.binary()),
                pa.array(np.arange(place, place + n) + (part << 40)),
            ], ["doc_id", "n_features", "buckets", "place"])
            place += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find, "doc_id long, n_features long, buckets binary, place long")


def _buckets_of(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: a row per bucket from each task, one per bucket to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                total += np.bincount(_buckets_of(batch.column(0).slice(at, ROWS), buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in sums.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of smoothed shares, for each bucket."""
    all_raw, all_target, buckets = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log(float(t + 1) * (all_raw + buckets)
                                                / (float(s + 1) * (all_target + buckets))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_features, place and weight: the floored mean of a document's gains, 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            n = batch.column(1).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[_buckets_of(batch.column(3), len(gains))])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.record_batch([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_features", "place", "weight"])

    return features.select("doc_id", "n_features", "place", "buckets").mapInArrow(
        weigh, "doc_id long, n_features long, place long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored with `rank` from 1 by descending score, then doc_id; null from place `drawn` on."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    placed = written(scored.repartitionByRange(shuffle_width(scored.sparkSession), *order)
                     .sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = placed.groupBy(part.alias("range")).count().select(
        "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + inside + 1
    return (placed.withColumn("range", part).join(F.broadcast(bases), "range")
            .withColumn("rank", F.when(rank <= drawn, rank)).drop("range", "base", "at"))


def resample(raw: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Every raw document with n_features, weight, score and its rank among those drawn."""
    features = written(feature_table(raw, buckets, run), "importance-features")
    aims = feature_table(target.select(F.lit(None).alias("doc_id"), "text"), buckets, run)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(aims, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighted(features, gains).withColumn("score", F.col("weight") + gumbel), "importance-scores")
    enough = F.col("n_features") >= least_features(least_words, run)
    chosen = scored.filter(enough)
    drawn = percent * chosen.count() // 100
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(chosen, drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def least_features(words: int, run: int) -> int:
    """Features of a text of so many words: the count rises with the words, so it decides as the words do."""
    return sum(max(0, words - n + 1) for n in range(1, run + 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE steps(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
doc_words AS (
  SELECT doc_id, len(w) AS n_features, w FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
spread AS (SELECT doc_id, unnest(w) AS word FROM doc_words),
raw_words AS (SELECT word, count(*) AS n FROM spread GROUP BY word),
target_words AS (SELECT word, count(*) AS n FROM item_words GROUP BY word),
spelt AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw_words UNION SELECT word FROM target_words)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda s, b: xor(s // 256, t[xor(s, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, crc_table),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM raw_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM target_words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000)
    / ((s.n + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
word_gains AS (SELECT word, gain FROM hashed JOIN gains USING (bucket)),
weights AS (
  SELECT doc_id, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM spread JOIN word_gains USING (word)
  GROUP BY doc_id),
scored AS (
  SELECT doc_id, n_features::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""

"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text becomes two parts of length 1: counts of hashed byte n-grams, damped and weighted by rarity, and how often words
repeat the word before them (the shares of the `PATTERNS` ways in which that happens among four words in a row, square
roots taken). A truncated singular value decomposition of a bounded sample of labelled texts (`SAMPLE` rows, chosen by a hash of the doc_id among the rows that
may be learnt from) gives the latent axes; the sample's vectors are sent to all tasks. Every document is projected, its
cosine with every labelled vector is computed in blocks, and its `NEIGHBOURS` nearest vote by a power of the cosine.

The score is the weighted share of votes for label 1, drawn a little towards the share among all labels. A text without
n-grams (null, empty, fewer than three bytes) has no neighbours and gets that share itself; without labels every score
is 0.5. A doc_id with several labels has the least of them; null labels and ids are not learnt. Repeated rows score
alike. Extra columns stay as they are. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.llm.common import in_small_batches, read_table
from wattmill.llm.grams import gram_counts
from wattmill.llm.word_codes import word_codes

NAME = "op9_neighbour_vote"
SQL = None  # a trained model
SAMPLE = 2000  # labelled rows the model is fitted on
BITS = 12
PATTERNS = 8  # of equal neighbours among four words
AXES = 64
NEIGHBOURS = 15
SHARPNESS = 8.0  # power of the cosine in a vote
CUT = 0.3  # predicted 1 from this score
BLOCK = 256  # documents in one matrix product


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def repeat_shares(codes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each pattern of equal neighbours; zeros for fewer than four words."""
    same = (codes[1:] == codes[:-1]).astype(np.int64)
    if len(same) < 3:
        return np.zeros(PATTERNS, np.float32)
    kinds = np.bincount(4 * same[:-2] + 2 * same[1:-1] + same[2:], minlength=PATTERNS)
    return np.sqrt(kinds / kinds.sum()).astype(np.float32)


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text: damped counts of n-grams, then the repeat shares."""
    out = np.zeros((len(texts), (1 << BITS) + PATTERNS), np.float32)
    for row, text, codes in zip(out, texts, word_codes([(t or "").encode() for t in texts])):
        row[:-PATTERNS] = np.log1p(gram_counts(text, BITS))
        row[-PATTERNS:] = repeat_shares(codes)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def joined_parts(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return np.hstack([unit_rows(rows[:, :-PATTERNS] * rarity), rows[:, -PATTERNS:]])


@dataclass
class Neighbours:
    rarity: np.ndarray  # weight of each bucket
    axes: np.ndarray  # buckets x axes
    vectors: np.ndarray  # labelled rows x axes, of length 1
    labels: np.ndarray
    share: float  # of label 1 among the labelled rows

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Score of each row of features."""
        empty = ~rows.any(axis=1)
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = unit_rows(joined_parts(rows, self.rarity) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        votes = (weight * self.labels[best]).sum(axis=1)
        score = (votes + 0.1 * self.share) / (weight.sum(axis=1) + 0.1)
        return np.where(empty, self.share, score)


def fit(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """Fit on at most SAMPLE labelled rows that are not held out."""
    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("labelled_id"), "label")
    texts = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select(
        "doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for x in features(batch.column(2).to_pylist()).astype(np.float16)]
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())],
                                  ["doc_id", "label", "features"])

    rows = texts.mapInArrow(count, "doc_id long, label int, features binary").dropDuplicates(["doc_id"]).orderBy(
        "doc_id").toPandas()  # at most SAMPLE rows of 2**BITS half floats
    width = 1 << BITS
    if not len(rows):
        none = np.zeros((0, AXES), np.float32)
        return Neighbours(np.ones(width, np.float32), np.zeros((width + PATTERNS, AXES), np.float32), none, none[:, 0], 0.5)
    x = np.stack([np.frombuffer(c, np.float16) for c in rows["features"]]).astype(np.float32)
    rarity = np.log((1 + len(x)) / (1 + (x[:, :width] > 0).sum(axis=0))).astype(np.float32) + 1
    x = joined_parts(x, rarity)
    values, left = np.linalg.eigh(x @ x.T)
    keep = np.argsort(-values)[:min(AXES, len(x))]
    keep = keep[values[keep] > 1e-6]
    axes = (x.T @ left[:, keep]) / np.sqrt(values[keep])
    labels_of = rows["label"].to_numpy(np.float64)
    return Neighbours(rarity, axes.astype(np.float32), unit_rows(x @ axes).astype(np.float32), labels_of,
                      float(labels_of.mean()))


def score_column(model: Neighbours) -> Column:
    """Score of the column `text`."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [model.scores(features(list(texts.iloc[at:at + BLOCK]))) for at in range(0, len(texts), BLOCK)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.col("text"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `score`."""
    return docs.withColumn("score", score_column(fit(docs, labels)))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score CUT or more, with their own columns alone."""
    return docs.withColumn("__score", score_column(fit(docs, labels))).filter(F.col("__score") >= CUT).drop("__score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))

"""Token files: frequency-ranked ids in a byte-aligned code whose control bytes stand apart from the data.

An id is replaced by its rank in the corpus (0: most frequent; ties by id) and written in one to four bytes. Two bits of
a control byte give the length of each rank, four ranks to a byte; control bytes and data bytes of a block are separate
streams, so a block is decoded without a loop: a table of 256 rows turns control bytes into lengths, a running sum into
places, and one gather into values. Each document is filled up to four ranks with rank 0, so blocks are concatenations.

A file set has three tables in one folder: `blocks` (bucket, block, start, doc_ids, n_tokens, control, data), `ranks`
(rank, id) and `buckets` (bucket, n_tokens). Documents stand in ascending doc_id order over buckets, blocks and places;
`start` counts the ids before the block inside its bucket.

Null texts count as empty and give the end id alone; null doc_ids come first; repeated rows are all kept, ordered by
their code; an empty table gives empty files. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.bpe import ROWS, encoder
from wattmill.llm.common import dealt_by_range, in_small_batches, read_table, scratch_path, shuffle_width, written

NAME = "op1_token_files"
SQL = None  # needs a tokenizer
BLOCK_TOKENS = 1 << 20

# For each control byte the lengths of its four values.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and the data length of each value; the number of values is a multiple of four."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8)
    extra += values > 0xFFFF
    extra += values > 0xFFFFFF
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control, data, extra.astype(np.int64) + 1


def unpack_values(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The values of a block by table lookup."""
    lengths = LENGTHS[control].ravel()
    ends = np.cumsum(lengths)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    at = ends - lengths
    values = padded[at].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        if not len(longer):
            break
        values[longer] |= padded[at[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def tokenized(docs: DataFrame, vocabulary: str, end: int | None) -> DataFrame:
    """doc_id, n_tokens and the ids of each whole text (little-endian, two bytes where the vocabulary allows)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        tail = b"" if end is None else np.array([end], words.dtype).tobytes()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids = [x + tail for x in words.encode_all(part.column(1).to_pylist())]
                counts = [len(x) // words.dtype.itemsize for x in ids]
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(counts, pa.int32()),
                                       pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens int, ids binary")


def ranked_ids(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(rank, id) of every id that occurs: counted per task, then summed, so at most one row per id leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        total = np.zeros(words.vocab_size, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(0).slice(at, 256)), words.dtype)
                total += np.bincount(ids, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    sums = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "id")  # as many rows as the vocabulary has ids
    return sums.select((F.row_number().over(order) - 1).alias("rank"), "id")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int) -> None:
    """Write the three tables of a file set for `docs` (doc_id, text) below `folder`."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocabulary, end), "tokens")
    ranked_ids(tokens, vocabulary).write.parquet(f"{folder}/ranks")
    pairs = spark.read.parquet(f"{folder}/ranks").toPandas()  # at most one row per id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        rank = np.zeros(words.vocab_size, np.uint32)
        rank[pairs["id"]] = pairs["rank"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                counts = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                room = (counts + 3) // 4 * 4
                ends = np.cumsum(room)
                values = np.zeros(ends[-1], np.uint32)
                ids = np.frombuffer(b"".join(x.as_buffer() for x in part.column(2)), words.dtype)
                shift = np.repeat(ends - room - (np.cumsum(counts) - counts), counts)
                values[np.arange(len(ids)) + shift] = rank[ids]
                control, data, lengths = pack_values(values)
                cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
                quads = np.concatenate([[0], ends // 4])
                control, data = control.tobytes(), data.tobytes()
                yield pa.record_batch([
                    part.column(0), part.column(1),
                    pa.array([control[a:b] for a, b in zip(quads, quads[1:])], pa.binary()),
                    pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ], ["doc_id", "n_tokens", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, block, held, tokens_held = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            bucket, ids, counts, control, data = zip(*held)
            return pa.record_batch([
                pa.array([bucket[0]], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                pa.array([b"".join(control)], pa.binary()), pa.array([b"".join(data)], pa.binary()),
            ], ["bucket", "block", "start", "doc_ids", "n_tokens", "control", "data"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (held[0][0] != row[0] or tokens_held + row[2] > BLOCK_TOKENS):
                    yield flush()
                    start, block = (start + tokens_held, block + 1) if held[0][0] == row[0] else (0, 0)
                    held, tokens_held = [], 0
                held.append(row)
                tokens_held += row[2]
        if held:
            yield flush()

    coded = tokens.mapInArrow(encode, "doc_id long, n_tokens int, control binary, data binary")
    dealt = dealt_by_range(coded, "doc_id", shuffle_width(spark), tokens.select("doc_id"))
    ordered = dealt.select("bucket", "doc_id", "n_tokens", "control", "data").sortWithinPartitions(
        "bucket", "doc_id", "n_tokens", "control", "data")
    ordered.mapInArrow(blocks, "bucket int, block int, start long, doc_ids array<long>, n_tokens array<int>, "
                               "control binary, data binary").write.option("compression", "zstd").parquet(
        f"{folder}/blocks")
    (spark.read.parquet(f"{folder}/blocks")
     .groupBy("bucket").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n_tokens"))
     .write.parquet(f"{folder}/buckets"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) from a file set."""
    pairs = spark.read.parquet(f"{folder}/ranks").toPandas()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    bases = spark.read.parquet(f"{folder}/buckets").select(
        "bucket", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = np.zeros(len(pairs) or 1, "<u4")
        ids_of[pairs["rank"]] = pairs["id"]
        for batch in batches:
            for i in range(len(batch)):
                start, doc_ids, counts, control, data = (batch.column(k)[i] for k in range(5))
                counts = np.array(counts.as_py(), np.int64)
                values = unpack_values(np.frombuffer(control.as_buffer(), np.uint8),
                                       np.frombuffer(data.as_buffer(), np.uint8))
                ids = ids_of[values].tobytes()
                room = np.cumsum((counts + 3) // 4 * 4)
                first = room - (counts + 3) // 4 * 4
                yield pa.record_batch([
                    pa.array(doc_ids.as_py(), pa.int64()),
                    pa.array(start.as_py() + np.cumsum(counts) - counts, pa.int64()),
                    pa.array([ids[4 * a:4 * (a + n)] for a, n in zip(first.tolist(), counts.tolist())], pa.binary()),
                ], ["doc_id", "start", "ids"])

    return (spark.read.parquet(f"{folder}/blocks").join(F.broadcast(bases), "bucket")
            .select((F.col("start") + F.col("base")).alias("start"), "doc_ids", "n_tokens", "control", "data")
            .mapInArrow(decode, "doc_id long, start long, ids binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of `documents` and give per document what the files say."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.as_buffer() for x in batch.column(2)]
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_files(spark, folder).mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

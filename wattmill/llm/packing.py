"""Shortest-pack-first packing over the histogram of lengths.

Documents are cut into pieces of the full width and one remainder. Full pieces are sequences by themselves. The
histogram of the remainders (at most width - 1 rows, however many documents there are) is packed on the driver: lengths
from the longest down, each put into the shortest open packs with room, as whole counts of a packing pattern; a pattern
is split only where a length runs out. A remainder then finds its sequence by rank: remainders are put in order of
(length, hash of the piece), so a position in that order falls into one interval (pattern, place in the pattern).

Sequences hold pieces at gapless offsets and are padded to the width, except those whose fill is a power of two.

Null texts count as empty (a document of the end id alone); repeated rows are packed as often as they occur; null doc_ids
are packed like others; an empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.bpe import ROWS, encoder
from wattmill.llm.common import in_small_batches, range_bucket, read_table, shuffle_width, written

NAME = "op3_packing"
SQL = None  # needs a tokenizer
WIDTH = 1024
PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth_full long"


def cut_pieces(docs: DataFrame, vocabulary: str, end: int, width: int) -> DataFrame:
    """Pieces of every document; full ones are numbered in their partition (`part`, `nth_full`)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, fulls = encoder(vocabulary), TaskContext.get().partitionId(), 0
        step = words.dtype.itemsize
        tail = np.array([end], words.dtype).tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            rows: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist())):
                ids += tail
                total = len(ids) // step
                for start in range(0, total, width):
                    length = min(width, total - start)
                    full = length == width
                    for column, value in zip(rows, (doc, start, length, total, ids[start * step:(start + length) * step],
                                                    part, fulls if full else None)):
                        column.append(value)
                    fulls += full
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)],
                                  [x.split()[0] for x in PIECES.split(", ")])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how often each occurs."""
    room: dict[int, Counter] = defaultdict(Counter)  # free space -> pattern -> count
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:
                room[width - length][(length,)] += left
                break
            pattern, n = room[space].popitem()
            used = min(n, left)
            if n > used:
                room[space][pattern] = n - used
            elif not room[space]:
                del room[space]
            room[space - length][(*pattern, length)] += used
            left -= used
    return sorted((p, n) for packs in room.values() for p, n in packs.items())


def placement(counts: dict[int, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Intervals of positions in the order of lengths: first position, its sequence, offset there; number of packs."""
    slots = defaultdict(list)
    packs = 0
    for pattern, n in pack_histogram(counts, width):
        offset = 0
        for length in pattern:
            slots[length].append((n, packs, offset))
            offset += length
        packs += n
    first, sequence, offsets, position = [], [], [], 0
    for length in sorted(slots):
        for n, pack, offset in slots[length]:
            first.append(position)
            sequence.append(pack)
            offsets.append(offset)
            position += n
    return np.array(first, np.int64), np.array(sequence, np.int64), np.array(offsets, np.int64), packs


def pack(docs: DataFrame, vocabulary: str, end: int = 0, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian, of the vocabulary's size), sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, vocabulary, end, width), "pieces")
    full, rest = pieces.filter(F.col("length") == width), pieces.filter(F.col("length") < width)
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer than `width` rows
    first, sequence, offsets, packs = placement(counts, width)

    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "start"), 16)
    keyed = rest.withColumn("rank_key", F.shiftleft(F.col("length").cast("long"), 48).bitwiseOR(hashed))
    bucketed = range_bucket(keyed, "rank_key", shuffle_width(spark))
    inside = Window.partitionBy("bucket").orderBy("rank_key", "doc_id", "start", "doc_tokens", "ids")
    ranked = written(bucketed.select(
        "doc_id", "start", "length", "doc_tokens", "ids", "bucket",
        (F.row_number().over(inside) - 1).cast("long").alias("place")), "ranked")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    bases = ranked.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0))
                                                    .alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("position").to_numpy()
            k = np.searchsorted(first, at, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence[k] + at - first[k]), pa.array(offsets[k])],
                                  [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = "doc_id long, start long, length int, doc_tokens long, ids binary, sequence_id long, offset long"
    packed = ranked.join(F.broadcast(bases), "bucket").select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("place")).alias("position")
    ).mapInArrow(place, columns)

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the input
    parts = full.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("base"))
    alone = full.join(F.broadcast(parts), "part").select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.col("base") + F.col("nth_full") + F.lit(packs)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def packing_digest(docs: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(vocabulary).dtype
        for batch in batches:
            doc, start, length, total, ids, sequence, offset = batch.columns
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes()) for x in ids]
            yield pa.record_batch([doc, start, length.cast(pa.int64()), pa.array(crc, pa.int64()), total, sequence,
                                   offset], [c.split()[0] for c in columns.split(", ")])

    return pack(docs, vocabulary).mapInArrow(digest, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(read_table(spark, sf_dir, "documents"))

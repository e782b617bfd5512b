"""Bounded-space online best-fit packing.

Documents arrive in the order of the table. One longer than the width is cut into full pieces, sequences by themselves,
and a rest; a rest or a shorter document is never cut. It goes into the open bin with the least free space that holds
it. Open bins are found by a bitset over free space: bit s is set while some open bin has s free places, so the best bin
for a length is the lowest set bit at or above it. A task holds `BINS` open bins and no more: where none fits and all are
open, the fullest one closes and is given out. A task so holds BINS times the width in ids, however much it reads.

The bins a task has still open at its end are not given out but taken apart: the pieces of `JOINED` tasks meet in one
task of a second pass, which packs them by the same rule, longest first and with room for all of their bins. Both passes
give numbers of their own to their sequences and write them, so a lost executor changes no number already used.

Null texts count as empty (a document of the end id alone); repeated rows are packed as often as they occur; null doc_ids
are packed like others; an empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.llm.common import read_table, written
from wattmill.llm.lower_bpe import lower_encoder

NAME = "op11_best_fit"
SQL = None  # needs a tokenizer
WIDTH = 2048
BINS = 1024  # open in a task
JOINED = 8  # tasks whose last open bins are packed together
ROWS = 512  # documents of a batch that are Python objects at once
PIECES = ("doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int, part int")
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class OpenBins:
    """At most `most` open bins of `width` places; add(item, length) gives the bins that close."""

    def __init__(self, width: int, most: int):
        self.width, self.most, self.open = width, most, 0
        self.bits = 0  # bit s: a bin with s free places is open
        self.by_space: dict[int, list[list]] = defaultdict(list)

    def _take(self, space: int) -> list:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def add(self, item: tuple, length: int) -> list[list]:
        closed = []
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            into = self._take(space)
        else:
            space, into = self.width, []
            if self.open == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        into.append(item)
        left = space - length
        if left:
            self.by_space[left].append(into)
            self.bits |= 1 << left
            self.open += 1
        else:
            closed.append(into)
        return closed

    def rest(self) -> Iterator[list]:
        """The bins that are still open, fullest first."""
        for space in sorted(self.by_space):
            yield from self.by_space[space]


class Rows:
    """Pieces on their way out, as Arrow batches of some hundred rows."""

    def __init__(self, part: int):
        self.part, self.columns = part, [[] for _ in NAMES]
        self.sequences = 0

    def add(self, pieces: list[tuple], whole: bool = True) -> None:
        """The pieces of one sequence; without a number and a place if it is to be packed anew."""
        number = (self.part << 32) + self.sequences if whole else None
        self.sequences += whole
        offset = 0
        for piece in pieces:
            for column, value in zip(self.columns, (*piece, number, offset if whole else None, self.part)):
                column.append(value)
            offset += piece[3]

    def taken(self, least: int = ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(self.columns, KINDS)], NAMES)
            self.columns = [[] for _ in NAMES]


def first_pass(docs: DataFrame, vocabulary: str, end: int, width: int, bins: int) -> DataFrame:
    """Pieces with their sequences; those of a task's last open bins have no sequence yet."""

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, out, space = lower_encoder(vocabulary), Rows(TaskContext.get().partitionId()), OpenBins(width, bins)
        step = words.dtype.itemsize
        tail = np.array([end], words.dtype).tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist())):
                ids += tail
                for piece, start in enumerate(range(0, len(ids) // step, width)):
                    cut = ids[start * step:(start + width) * step]
                    row = (doc, piece, start, len(cut) // step, cut)
                    for closed in space.add(row, row[3]) if row[3] < width else [[row]]:
                        out.add(closed)
                yield from out.taken()
        for left in space.rest():
            out.add(left, whole=False)
            yield from out.taken()
        yield from out.taken(least=1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack_task, PIECES)


def second_pass(pieces: DataFrame, tasks: int, width: int, bins: int) -> DataFrame:
    """The pieces without a sequence, those of JOINED tasks packed together, longest first."""
    groups = -(-tasks // JOINED)

    def pack_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, space = None, OpenBins(width, 2 * JOINED * bins)  # as many as the pieces' first bins, and room to spare
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or Rows(tasks + row[5] // JOINED)
                for closed in space.add(row[:5], row[3]):
                    out.add(closed)
                    yield from out.taken()
        if out:
            for left in space.rest():
                out.add(left)
                yield from out.taken()
            yield from out.taken(least=1)

    order = [F.desc("length"), "doc_id", "piece", "start", "part", "ids"]
    return (pieces.select("doc_id", "piece", "start", "length", "ids", "part")
            .repartitionById(groups, F.expr(f"part div {JOINED}").cast("int"))
            .sortWithinPartitions(*order).mapInArrow(pack_group, PIECES))


def pack(docs: DataFrame, vocabulary: str, end: int = 0, width: int = WIDTH, bins: int = BINS) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, of the vocabulary's size), sequence_id, offset."""
    pieces = written(first_pass(docs, vocabulary, end, width, bins), "best-fit")
    tasks = pieces.agg(F.max("part")).first()[0]
    done = pieces.filter("sequence_id is not null")
    if tasks is not None:
        rest = second_pass(pieces.filter("sequence_id is null"), tasks + 1, width, bins)
        done = done.unionByName(written(rest, "best-fit-rest"))
    return done.drop("part")


def packing_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    columns = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = lower_encoder(vocabulary).dtype
        for batch in batches:
            doc, piece, start, length, ids, sequence, offset = batch.columns
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes()) for x in ids]
            yield pa.record_batch([doc, piece, start, length.cast(pa.int64()), pa.array(crc, pa.int64()), sequence,
                                   offset.cast(pa.int64())], [c.split()[0] for c in columns.split(", ")])

    return pack(docs, vocabulary).mapInArrow(digest, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

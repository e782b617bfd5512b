"""Cross-tokenizer alignment, with corpus-wide counts of linked id pairs by external spill counting.

Two tokenizers cut each text; where both end a token, a group ends, and tokens of the two sides whose bytes overlap are
linked (`word_alignment`). A pair's count is the number of documents that hold it linked. It is found like this:

1. A task holds the links of some documents, a chunk, until they are `CHUNK_LINKS`. It then spills them: the records
   (pair, document, times) are dealt by radix, sorted side-major (A id, B id, document) and written as runs of blocks,
   compressed by zstd, with the number of documents of each pair beside them. The radix mixes the A id with a few bits of
   the B id, so a frequent A id lies in several radixes and no pair in two.
2. Only the pairs and their numbers are shuffled, by radix. A heap holds the open blocks by their next pair; as blocks
   come in the order of their first pair, all pairs before the newest block's first one are complete, are taken off the
   heap and added up. Each block gets the totals of its pairs back, and as pairs stand side-major, the largest total of
   an A id is known when its pairs have passed; over the radixes that makes one number per id of the vocabulary.
3. Records and totals of a chunk meet and are streamed back to its documents as sums.

A task holds one chunk, or the blocks that overlap in their pairs; hot pairs were added up within chunks before.

Null and empty texts, and texts whose two spellings differ from a blank and the text, have no tokens: zeros and no
groups. A document is a row, so repeated rows count as often as they occur; null doc_ids are kept; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.llm.common import read_table, shuffle_width, written
from wattmill.llm.word_alignment import word_aligner

NAME = "op13_alignment"
SQL = None  # needs two tokenizers
CHUNK_LINKS = 4_000_000
CHUNK_DOCS = 50_000
BLOCK_PAIRS = 1 << 13
PENDING = 1 << 19  # pairs that come in between two looks at the heap
ROWS = 512  # documents of a batch that are Python objects at once
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, near 2**64 divided by the golden ratio

DOC, BLOCK, TOTALS = 0, 1, 2
RUNS = ("chunk long, radix int, block int, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups string, first long, pairs binary, holders binary, docs binary, times binary")
NAMES = [c.split()[0] for c in RUNS.split(", ")]
KINDS = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]
         for c in RUNS.split(", ")]


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest whole bytes, compressed; the first byte is their size."""
    most = int(values.max()) if len(values) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    return bytes([size]) + zstandard.compress(values.astype(f"<u{size}").tobytes(), 1)


def loose(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<u{raw[0]}").astype(np.uint64)


def radix_of(pairs: np.ndarray, shift: int, radixes: int) -> np.ndarray:
    """The radix of each pair: by its A id and three bits of its B id."""
    key = (pairs >> np.uint64(shift) << np.uint64(3)) + (pairs & np.uint64(7))
    return ((key * SPREAD >> np.uint64(33)) % np.uint64(radixes)).astype(np.int64)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where a run of equal neighbours starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


class Chunk:
    """Documents of a task and their links, on their way to sorted runs."""

    def __init__(self, shift: int, radixes: int, most_links: int, block_pairs: int):
        self.shift, self.radixes, self.most_links, self.block_pairs = shift, radixes, most_links, block_pairs
        self.rows: list[tuple] = []
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, row: tuple, links: np.ndarray) -> None:
        self.rows.append(row)
        self.links.append(links)
        self.size += len(links)

    def full(self) -> bool:
        return self.size >= self.most_links or len(self.rows) >= CHUNK_DOCS

    def spilled(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row per document, then the runs, a row per block."""
        for at in range(0, len(self.rows), 4 * ROWS):
            part = self.rows[at:at + 4 * ROWS]
            yield _batch([[number] * len(part), [-1] * len(part), range(at, at + len(part)), [DOC] * len(part),
                          *zip(*part)])
        if self.size:
            yield from self._runs(number)

    def _runs(self, number: int) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.arange(len(self.rows), dtype=np.uint64), [len(x) for x in self.links])
        bits = np.uint64(max(1, len(self.rows) - 1).bit_length())
        keys = np.concatenate(self.links).astype(np.uint64)
        self.links = []
        keys <<= bits
        keys |= doc
        del doc
        keys.sort()
        first = starts_of(keys)
        times = np.diff(np.r_[first, len(keys)]).astype(np.uint64)
        records = keys[first]
        del keys
        pair, doc = records >> bits, records & ((np.uint64(1) << bits) - np.uint64(1))
        first = starts_of(pair)
        holders = np.diff(np.r_[first, len(pair)])
        pairs = pair[first]
        radix = radix_of(pairs, self.shift, self.radixes)
        order = np.argsort(radix, kind="stable")
        edges = np.r_[starts_of(radix[order]), len(order)]
        columns: list[list] = [[] for _ in range(8)]
        for a, b in zip(edges, edges[1:]):
            for block, at in enumerate(range(a, b, self.block_pairs)):
                chosen = order[at:min(b, at + self.block_pairs)]
                n = holders[chosen]
                place = np.repeat(first[chosen] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                mine = pairs[chosen]
                for column, value in zip(columns, (
                        int(radix[chosen[0]]), block, int(mine[0]), squeezed(np.diff(mine, prepend=mine[:1])),
                        squeezed(n), squeezed(doc[place]), squeezed(times[place]), number)):
                    column.append(value)
        none = [None] * len(columns[0])
        yield _batch([columns[7], columns[0], columns[1], [BLOCK] * len(none), *[none] * 6, *columns[2:7]])


def _batch(columns: list) -> pa.RecordBatch:
    n = len(columns[0])
    columns = [*columns, *[[None] * n] * (len(NAMES) - len(columns))]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, KINDS)], NAMES)


def spilled_runs(docs: DataFrame, path_a: str, path_b: str, radixes: int, texts: bool, chunk_links: int = CHUNK_LINKS,
                 block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The documents and the runs of their links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number = word_aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        nothing = np.zeros(0, words.dtype)
        chunk = Chunk(words.shift, radixes, chunk_links, block_pairs)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            for doc, found in zip(batch.column(0).to_pylist(), words.aligned(batch.column(1).to_pylist())):
                groups, links, n_a = found or ("", nothing, 0)
                n_groups = groups.count(";") + 1 if found else 0
                n_b = groups.count(",") + 2 * n_groups - n_a
                if groups and not texts:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                chunk.add((doc, n_a, n_b, n_groups, len(links), groups), links)
                if chunk.full():
                    yield from chunk.spilled(number)
                    number, chunk = number + 1, Chunk(words.shift, radixes, chunk_links, block_pairs)
        yield from chunk.spilled(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, RUNS)


class Merge:
    """A k-way merge of the blocks of one radix, which come in the order of their first pairs."""

    def __init__(self, shift: int):
        self.shift = np.uint64(shift)
        self.heap: list[tuple[int, int, dict]] = []  # next pair, age, block
        self.taken = self.waiting = 0
        self.most: dict[int, int] = {}

    def add(self, key: tuple, pairs: np.ndarray, holders: np.ndarray) -> None:
        block = {"key": key, "pairs": pairs, "holders": holders, "at": 0, "totals": np.empty(len(pairs), np.uint64)}
        heapq.heappush(self.heap, (int(pairs[0]), self.taken, block))
        self.taken += 1
        self.waiting += len(pairs)

    def complete(self, before: int | None) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """Add up all pairs below `before` (None: all); gives (key, pairs, totals) of the blocks that are through."""
        parts = []
        while self.heap and (before is None or self.heap[0][0] < before):
            _, age, block = heapq.heappop(self.heap)
            at, pairs = block["at"], block["pairs"]
            end = len(pairs) if before is None else int(np.searchsorted(pairs, np.uint64(before)))
            parts.append((block, at, end))
            block["at"] = end
            if end < len(pairs):
                heapq.heappush(self.heap, (int(pairs[end]), age, block))
        self.waiting = 0
        if not parts:
            return
        pairs = np.concatenate([b["pairs"][s:e] for b, s, e in parts])
        order = np.argsort(pairs, kind="stable")
        first = starts_of(pairs[order])
        sums = np.add.reduceat(np.concatenate([b["holders"][s:e] for b, s, e in parts])[order], first)
        totals = np.empty(len(pairs), np.uint64)
        totals[order] = np.repeat(sums, np.diff(np.r_[first, len(pairs)]))
        side = pairs[order][first] >> self.shift
        edges = starts_of(side)
        for a, most in zip(side[edges].tolist(), np.maximum.reduceat(sums, edges).tolist()):
            self.most[a] = max(most, self.most.get(a, 0))
        at = 0
        for block, s, e in parts:
            block["totals"][s:e] = totals[at:at + e - s]
            at += e - s
            if e == len(block["pairs"]):
                yield block["key"], block["pairs"], block["totals"]


def merged_totals(runs: DataFrame, shift: int, radixes: int, pending: int = PENDING) -> DataFrame:
    """Totals for each block (chunk, radix, block), and rows (a, most) with the largest total of an A id in a radix."""
    schema = "chunk long, radix int, block int, totals binary, a long, most long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        state, radix = Merge(shift), None

        def answers(before: int | None) -> Iterator[pa.RecordBatch]:
            done = [(*key, squeezed(totals), None, None) for key, _, totals in state.complete(before)]
            if done:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        def largest() -> Iterator[pa.RecordBatch]:
            if state.most:
                none = [None] * len(state.most)
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(
                    (none, none, none, none, state.most.keys(), state.most.values()), kinds)], names)

        for batch in batches:
            for chunk, now, block, first, pairs, holders in zip(*(c.to_pylist() for c in batch.columns)):
                if now != radix:
                    yield from answers(None)
                    yield from largest()
                    state, radix = Merge(shift), now
                if state.waiting >= pending:
                    yield from answers(first)
                state.add((chunk, now, block), np.uint64(first) + np.cumsum(loose(pairs)), loose(holders))
        yield from answers(None)
        yield from largest()

    return (runs.filter(f"kind = {BLOCK}").select("chunk", "radix", "block", "first", "pairs", "holders")
            .repartitionById(radixes, F.col("radix")).sortWithinPartitions("radix", "first", "chunk", "block")
            .mapInArrow(merge, schema))


def document_sums(runs: DataFrame, totals: DataFrame, most: np.ndarray, shift: int) -> DataFrame:
    """The documents with n_best and count_sum: records and totals of a chunk side by side in one task."""
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    answers = totals.filter("totals is not null").select("chunk", "radix", "block", F.lit(TOTALS).alias("kind"), "totals")
    both = runs.unionByName(answers, allowMissingColumns=True)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        docs: list[tuple] = []
        chunk, held = None, None
        best, sums = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(docs), 4 * ROWS):
                part = list(zip(*docs[at:at + 4 * ROWS]))
                end = at + len(part[0])
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in part[:5]), pa.array(best[at:end]),
                                       pa.array(sums[at:end]), pa.array(part[5], pa.string())], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != chunk:
                    yield from out()
                    chunk, docs = row[0], []
                    best, sums = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                if row[1] == DOC:
                    docs.append(row[2:8])
                elif row[1] == BLOCK:
                    held = row[8:13]
                else:
                    first, pairs, holders, ids, times = held
                    n = loose(holders).astype(np.int64)
                    count = loose(row[13]).astype(np.int64)
                    side = (np.uint64(first) + np.cumsum(loose(pairs))) >> np.uint64(shift)
                    times, ids = loose(times).astype(np.int64), loose(ids).astype(np.int64)
                    np.add.at(sums, ids, times * np.repeat(count, n))
                    np.add.at(best, ids, times * np.repeat(count == most[side.astype(np.int64)], n))
        yield from out()

    columns = ["chunk", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "first", "pairs", "holders",
               "docs", "times", "totals"]
    return (both.repartition("chunk").sortWithinPartitions("chunk", "radix", "block", "kind")
            .select(*columns).mapInArrow(add_up, schema))


def align(docs: DataFrame, path_a: str, path_b: str, texts: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`texts` false: their sha256) of each document."""
    radixes = shuffle_width(docs.sparkSession)
    shift = word_aligner(path_a, path_b).shift
    runs = written(spilled_runs(docs, path_a, path_b, radixes, texts), "alignment-runs")
    totals = written(merged_totals(runs, shift, radixes), "alignment-totals")
    most = np.zeros(len(word_aligner(path_a, path_b).length_a), np.int64)
    for a, n in totals.filter("a is not null").groupBy("a").agg(F.max("most")).collect():  # at most one row per A id
        most[a] = n
    return document_sums(runs, totals, most, shift)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"), texts=False)
    return docs.withColumnRenamed("groups", "groups_sha256")

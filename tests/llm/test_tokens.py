"""Token files and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_rows import as_docs, multiset, prose
from tokenizers import Tokenizer

from wattmill.llm import packing, token_files
from wattmill.llm.bpe import WordEncoder
from wattmill.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, prose(1, 900)), (1, None), (2, ""), (3, "a  b\n\n c\t<|endoftext|> d"), (4, prose(2, 30)), (4, prose(2, 30)),
        (None, "no id"), (9, prose(3, 3000) + "\nend"), (7, "é ü 😀 \x1c \0 z")]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text, end):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_words_encoded_apart_equal_whole_texts(tok):
    random.seed(3)
    bits = ["a", "the", " ", "\n", "\t", "\xa0", "\x85", "!", ".", "'s", "1", "é", "<|endoftext|>", "\0", "\r", "😀", "Ġ"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(4000)] + [t for _, t in ROWS]
    encoder = WordEncoder(PATH)
    for _ in range(2):
        for text, got in zip(texts, encoder.encode_all(texts)):
            assert list(np.frombuffer(got, encoder.dtype)) == tok.encode(text or "", add_special_tokens=False).ids


def test_values_survive_the_code():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    control, data, lengths = token_files.pack_values(values)
    assert len(control) == 2 and lengths.tolist() == [1, 1, 2, 2, 3, 4, 4, 1] and len(data) == lengths.sum()
    assert (token_files.unpack_values(control, data) == values).all()
    none = np.zeros(0, np.uint8)
    assert len(token_files.unpack_values(none, none)) == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_files_hold_every_document_in_order(spark, tok, rows):
    docs = as_docs(spark, rows).selectExpr("*", "1 as ids", "2 as bucket", "3 as n_tokens", "4 as `rank`")
    folder = scratch_path(spark, "test")
    token_files.write_token_files(docs, folder, PATH, 2)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    start = 0
    for row in got:
        assert row.start == start
        start += len(row.ids) // 4
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    want = multiset((i, ids_of(tok, t, 2).tobytes()) for i, t in rows)
    assert multiset((r.doc_id, bytes(r.ids)) for r in got) == want
    ranks = sorted(spark.read.parquet(f"{folder}/ranks").collect())
    counts = np.bincount(np.concatenate([ids_of(tok, t, 2) for _, t in rows] or [[]]).astype(int), minlength=1)
    assert [r.id for r in ranks] == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_histogram_packs_hold_every_length_once():
    random.seed(5)
    for counts in ({}, {1023: 3, 1: 2}, {random.randint(1, 1023): random.randint(1, 9) for _ in range(200)}):
        packs = packing.pack_histogram(counts, 1024)
        used = {}
        for pattern, n in packs:
            assert sum(pattern) <= 1024 and list(pattern) == sorted(pattern, reverse=True)
            for length in pattern:
                used[length] = used.get(length, 0) + n
        assert used == counts
    assert packing.pack_histogram({1023: 3, 1: 2}, 1024) == [((1023,), 1), ((1023, 1), 2)]


@pytest.mark.parametrize("rows", [ROWS + [(100 + i, prose(i, 40 + i)) for i in range(150)], []])
def test_pieces_cover_documents_and_fill_sequences(spark, tok, rows):
    docs = as_docs(spark, rows).selectExpr("*", "1 as length", "2 as start", "3 as bucket")
    got = packing.packing_digest(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = {}
    for i, text in rows:
        ids = ids_of(tok, text, 0)
        cuts = range(0, len(ids), 1024)
        want.setdefault(i, []).extend((s, len(ids[s:s + 1024]), zlib.crc32(ids[s:s + 1024].tobytes()), len(ids))
                                      for s in cuts)
    assert {i: multiset((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rs) for i, rs in by_doc.items()} \
        == {i: multiset(x) for i, x in want.items()}


def test_packing_wastes_little(spark, sample):
    rows = packing.query(spark, sample).groupBy("sequence_id").sum("length").collect()
    fills = [r[1] for r in rows]
    padded = sum(0 if f & (f - 1) == 0 else 1024 - f for f in fills)
    assert padded < 0.05 * sum(fills)

"""Best-fit packing against the tokenizer itself and against plain best-fit without a bitset."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_rows import as_docs, multiset, prose
from tokenizers import Tokenizer

from wattmill.llm import best_fit
from wattmill.llm.lower_bpe import LowerWordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(5, prose(1, 900)), (1, None), (2, ""), (3, "A  b\n\n c\t<|endoftext|> d"), (4, prose(2, 30)), (4, prose(2, 30)),
        (None, "no id"), (9, prose(3, 6000) + "\nend"), (7, "é ü 😀 \x1c \0 z İ.")]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_words_encoded_apart_equal_whole_texts(tok):
    random.seed(3)
    bits = ["a", "the", "The", " ", "\n", "\t", "\xa0", "\x85", "!", ".", "'s", "'", "1", "é", "é", "́", "İ", "Σ",
            "<|endoftext|>", "<|EndOfText|>", "\0", "\r", "😀", "ǅ", "क़", "\x1c", "ᄒ", "ᅡ", "中文", "ß"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(8000)] + [t for _, t in ROWS]
    encoder = LowerWordEncoder(PATH)
    for _ in range(2):
        for text, got in zip(texts, encoder.encode_all(texts)):
            assert list(np.frombuffer(got, encoder.dtype)) == tok.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(lengths, width, most):
    """Every closed or open bin, found by looking at all bins."""
    open_bins, closed = [], []
    for n in lengths:
        fitting = [b for b in open_bins if width - sum(b) >= n]
        if fitting:
            into = max(fitting, key=sum)
        else:
            if len(open_bins) == most:
                full = max(open_bins, key=sum)
                open_bins.remove(full)
                closed.append(full)
            into = []
            open_bins.append(into)
        into.append(n)
        if sum(into) == width:
            open_bins.remove(into)
            closed.append(into)
    return closed, open_bins


def test_bitset_finds_the_fullest_bin_that_fits():
    random.seed(8)
    for most in (1, 2, 5, 40):
        lengths = [random.randint(1, 63) for _ in range(400)]
        space, closed = best_fit.OpenBins(64, most), []
        for n in lengths:
            closed += space.add((n,), n)
            assert space.open <= most
        want, left = plain_best_fit(lengths, 64, most)
        # ties between bins of one fill are free, so the fills are compared and not the contents
        assert sorted(sum(x for x, in b) for b in closed) == sorted(map(sum, want))
        assert sorted(sum(x for x, in b) for b in space.rest()) == sorted(map(sum, left))


def held(got, width):
    """The pieces by document, after looking at the sequences."""
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= width
    return {i: multiset(p) for i, p in by_doc.items()}, len(by_sequence)


@pytest.mark.parametrize("rows", [ROWS + [(100 + i, prose(i, 40 + 9 * i)) for i in range(150)], []])
def test_pieces_cover_documents_and_fill_sequences(spark, tok, rows):
    docs = as_docs(spark, rows).selectExpr("*", "1 as length", "2 as start", "3 as part", "4 as sequence_id")
    by_doc, sequences = held(best_fit.packing_digest(docs.repartition(20), PATH).collect(), 2048)
    want, total = {}, 0
    for i, text in rows:
        ids = ids_of(tok, text)
        total += len(ids)
        want.setdefault(i, []).extend((p, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()))
                                      for p, s in enumerate(range(0, len(ids), 2048)))
    assert by_doc == {i: multiset(x) for i, x in want.items()}
    assert sequences <= 1.1 * math.ceil(total / 2048) + 2


def test_few_open_bins_lose_nothing(spark, tok):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(300)]
    got = best_fit.pack(as_docs(spark, rows).repartition(3), PATH, width=64, bins=3).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.length <= 64 and r.start == 64 * r.piece
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {i: ids_of(tok, t).astype("<u2").tobytes() for i, t in rows}


def test_packing_wastes_little(spark, sample):
    rows = best_fit.query(spark, sample).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * math.ceil(total / 2048)

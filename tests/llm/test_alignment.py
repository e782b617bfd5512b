"""Alignment of two tokenizers against all pairs of tokens and plain dictionaries."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_rows import as_docs, multiset, prose
from tokenizers import Tokenizer

from wattmill.llm import alignment
from wattmill.llm.common import written
from wattmill.llm.word_alignment import WordAligner

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(5, prose(1, 300)), (1, None), (2, ""), (3, "A  b\n\n c\t<|endoftext|> </s> d"), (4, prose(2, 30)),
        (4, prose(2, 30)), (None, "no id"), (9, prose(3, 700) + "\nend"), (7, "é ü 😀 \x1c \0 z"), (8, "odd ▁ mark"),
        (10, " "), (11, "the the the the")]


class Plain:
    """Tokens of both sides of a text, and all pairs that overlap."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def piece(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        raw = (" " + (text or "")).encode()
        a, b = self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.b.encode(text or "")
        spelt_a, spelt_b = [self.bytes_a[i] for i in a], [self.piece(i) for i in b]
        if not text or b"".join(spelt_a) != raw or b"".join(spelt_b) != raw:
            return [], [], "", []
        ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]), np.cumsum([len(x) for x in spelt_b])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.tolist().index(end) + 1, ends_b.tolist().index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        starts_a, starts_b = ends_a - [len(x) for x in spelt_a], ends_b - [len(x) for x in spelt_b]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
        return a, b, ";".join(groups), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_words_aligned_apart_equal_whole_texts(plain):
    random.seed(1)
    bits = ["a", "the", " Hello", " ", "\n", "\t", "\xa0", "!", ".", ",", "'s", "1", "é", "é", "<|endoftext|>", "<s>",
            "\0", "\r", "😀", "Ġ", "▁", "中文", "  ", "\x1c", "ﬁ", "<0x0A>"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(2000)] + [t for _, t in ROWS]
    words = WordAligner(A, B)
    for _ in range(2):
        for text, got in zip(texts, words.aligned(texts), strict=True):
            a, _, groups, links = plain(text)
            if not a:
                assert got is None
                continue
            codes = [(x << words.shift) + y for x, y in links]
            assert (got[0], sorted(got[1].tolist()), got[2]) == (groups, sorted(codes), len(a))


def brute(plain, rows):
    found = [(doc, *plain(text)) for doc, text in rows]
    held = collections.Counter(p for *_, links in found for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(doc, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
             sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), groups)
            for doc, a, b, groups, links in found]


ROWS_AND_COPIES = ROWS + [(20 + i, prose(i % 7, 3 + i)) for i in range(40)]


def test_counts_equal_plain_dictionaries(spark, plain):
    docs = as_docs(spark, ROWS_AND_COPIES).selectExpr("*", "1 as chunk", "2 as kind", "3 as n_a", "4 as radix")
    got = alignment.align(docs.repartition(3), A, B).collect()
    assert multiset(got) == multiset(brute(plain, ROWS_AND_COPIES))


def test_many_chunks_and_blocks(spark, plain):
    """Chunks of a few links, blocks of two pairs, and a merge that looks at its heap at every block."""
    docs = as_docs(spark, ROWS_AND_COPIES).repartition(3)
    shift = WordAligner(A, B).shift
    runs = written(alignment.spilled_runs(docs, A, B, 5, True, chunk_links=60, block_pairs=2), "test")
    assert runs.select("chunk").distinct().count() > 20 and runs.agg({"block": "max"}).first()[0] > 3
    totals = written(alignment.merged_totals(runs, shift, 5, pending=1), "test")
    most = np.zeros(60_000, np.int64)
    for a, n in totals.filter("a is not null").groupBy("a").agg({"most": "max"}).collect():
        most[a] = n
    got = alignment.document_sums(runs, totals, most, shift).collect()
    assert multiset(got) == multiset(brute(plain, ROWS_AND_COPIES))


def test_merge_adds_up_overlapping_blocks():
    random.seed(6)
    blocks = []
    for key in range(30):
        pairs = np.array(sorted(random.sample(range(400), random.randint(1, 60))), np.uint64)
        blocks.append((key, pairs, np.array([random.randint(1, 9) for _ in pairs], np.uint64)))
    blocks.sort(key=lambda b: (b[1][0], b[0]))
    want = collections.Counter()
    for _, pairs, holders in blocks:
        want.update(dict(zip(pairs.tolist(), [0] * len(pairs))))
        for p, h in zip(pairs.tolist(), holders.tolist()):
            want[p] += h
    for every in (1, 4, 100):
        merge, got = alignment.Merge(3), {}
        for i, (key, pairs, holders) in enumerate(blocks):
            if i % every == 0:
                got.update({k: (p, t) for k, p, t in merge.complete(int(pairs[0]))})
            merge.add(key, pairs, holders)
        got.update({k: (p, t) for k, p, t in merge.complete(None)})
        assert len(got) == 30
        assert all(t.tolist() == [want[x] for x in p.tolist()] for p, t in got.values())
        most = collections.defaultdict(int)
        for p, n in want.items():
            most[p >> 3] = max(most[p >> 3], n)
        assert merge.most == most


def test_empty_table_and_query(spark, plain, sample):
    assert alignment.align(as_docs(spark, []), A, B).collect() == []
    got = {r.doc_id: r for r in alignment.query(spark, sample).collect()}
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in sorted(docs, key=lambda r: len(r.text or ""))[:60]:
        a, b, groups, links = plain(text)
        r = got[doc]
        assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(links))
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")

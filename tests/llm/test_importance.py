"""CRCs against zlib, and resampling against a plain loop over words."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from corpus_rows import FIXED, as_docs, multiset, prose

from wattmill.llm import importance
from wattmill.llm.position_crc import span_crcs

ROWS = [(5, prose(1, 300)), (1, None), (2, ""), (3, "A-b  C\n\n <é>ü3 \x00 \x7f"), (4, prose(2, 30)), (4, prose(2, 30)),
        (None, prose(3, 25)), (None, prose(3, 25)), (9, "X" * 5000 + " y"), (-8, " ".join(["same"] * 20)), (8, "!!")]
ITEMS = [(1, prose(1, 40)), (2, None), (3, "y Y y")]


def words_of(text):
    lower = (text or "").translate({ord(c): c.lower() for c in FIXED})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text, run=1):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def brute(rows, items, buckets=10_000, run=1):
    raw, target = (collections.Counter(bucket(f, buckets) for _, t in part for f in features_of(t, run))
                   for part in (rows, items))
    s_all, t_all = sum(raw.values()), sum(target.values())
    out = []
    for doc, text in rows:
        feats = features_of(text, run)
        gains = [math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
                 for b in (bucket(f, buckets) for f in feats)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(feats), weight, score, len(words_of(text)) >= 20))
    chosen = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, chosen


def test_spans_have_the_crc_of_their_bytes():
    random.seed(2)
    data = np.frombuffer(random.randbytes(20_000), np.uint8)
    for most in (1, 5, 64, 65, 700, 9_000):
        starts = np.array([random.randint(0, 9_000) for _ in range(60)])
        ends = starts + np.array([random.randint(1, most) for _ in range(60)])
        want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
        assert span_crcs(data, starts, ends).tolist() == want
    assert len(span_crcs(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize("size", [1 << 20, 37])
def test_buckets_of_words_and_runs(monkeypatch, run, size):
    monkeypatch.setattr(importance, "SLICE", size)
    random.seed(4)
    bits = ["a", "B", "the", " ", "\n", "é", "😀", "-", "9", "[", "`", "{", "\x7f", "zz"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(500)] + [t for _, t in ROWS]
    for text, got in zip(texts, importance.text_buckets(texts, run=run), strict=True):
        assert collections.Counter(got.tolist()) == collections.Counter(bucket(f) for f in features_of(text, run))


@pytest.mark.parametrize("rows, items, percent", [(ROWS, ITEMS, 10), (ROWS, ITEMS, 60), (ROWS, [], 100), ([], ITEMS, 10),
                                                  ([], [], 10)])
def test_draw_equals_a_plain_loop(spark, rows, items, percent):
    docs = as_docs(spark, rows).selectExpr("*", "1 as place", "2 as score", "3 as `rank`", "4 as buckets")
    target = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as place", "2 as weight")
    got = importance.resample(docs.repartition(5), target, percent).collect()
    want, chosen = brute(rows, items)
    assert multiset(r[:4] for r in got) == multiset(r[:4] for r in want)
    drawn = percent * len(chosen) // 100
    by_rank = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in by_rank] == list(range(1, drawn + 1))
    assert [tuple(r[:4]) for r in by_rank] == [r[:4] for r in chosen[:drawn]]


def test_pairs_of_words_are_drawn_alike(spark):
    rows = [(i, prose(i, 15 + i % 20)) for i in range(60)]
    got = importance.resample(as_docs(spark, rows), as_docs(spark, ITEMS), 50, buckets=70_000, run=2).collect()
    want, chosen = brute(rows, ITEMS, 70_000, 2)
    assert multiset(r[:4] for r in got) == multiset(r[:4] for r in want)
    assert {r.doc_id for r in got if r.rank} == {r[0] for r in chosen[:len(chosen) // 2]}

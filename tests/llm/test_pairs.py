"""Similarity join and decontamination against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import oracle_check
import pyarrow as pa
import pytest
from corpus_rows import as_docs, multiset, prose, words

from wattmill.llm import decontaminate, jaccard_join
from wattmill.llm.signature_tree import tree_links
from wattmill.llm.word_codes import set_code, shingle_sets, word_codes


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    first = {t: min([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), first[top(i)]) for i in range(len(rows))]


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else w + "x" for w in text.split(" "))


def near_rows():
    rows = [(i, prose(i, 60 + i)) for i in range(20)]
    base = prose(50, 300)
    rows += [(100 + k, edited(base, 0.01 * (k % 7), k)) for k in range(60)]
    rows += [(300 + k, base + " " + prose(60 + k, 10 * k)) for k in range(15)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "ONE two"), (405, "one two three four"),
             (406, "one two three four five"), (406, "one two three four five"), (None, prose(3, 63)), (7, "ties ties"),
             (500, "a a a a a a a a"), (501, "a a a a a"), (502, "été ÉTÉ x y z"), (503, "été été x y z")]
    return rows


@pytest.mark.parametrize("rows", [near_rows(), []])
def test_components_equal_brute_force(spark, rows):
    docs = as_docs(spark, rows).selectExpr("*", "1 as class", "2 as label", "3 as codes", "4 as n")
    got = jaccard_join.similar_documents(docs).collect()
    assert multiset(got) == multiset(components(rows))


def test_representatives_keep_one_row_of_each_group(spark):
    rows = near_rows()
    docs = as_docs(spark, rows).selectExpr("*", "'x' as class", "5 as n")
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    named = multiset((d, s) for d, s, c in components(rows) if d is not None and d == c and s)
    got = multiset((r.doc_id, len(shingles(r.text))) for r in kept.collect() if r.doc_id is not None and words(r.text))
    assert set(got) == set(named) and max(got.values()) == 1
    assert {r.doc_id for r in kept.collect() if not words(r.text)} == {400, 401, 402}


def test_shared_codes_are_counted_over_batches(spark, monkeypatch):
    """Counts of codes in several classes, with runs cut by sends and batches, against sets of all codes."""
    monkeypatch.setattr(jaccard_join, "HELD_CODES", 150)
    monkeypatch.setattr(jaccard_join, "GATHERED", 3)
    rows = near_rows()
    texts = [t for _, t in rows]

    def runs(step, schema, table, by):
        order = table.sort_by([(c, "ascending") for c in by])
        return pa.Table.from_batches(list(step(iter(order.to_batches(max_chunksize=5)))), order.schema if schema is None else schema)

    batches = [pa.record_batch([pa.array([i for i, _ in rows[k::4]], pa.int64()), pa.array(texts[k::4], pa.string())],
                               ["doc_id", "text"]) for k in range(4)]
    kinds = {name: pa.schema([pa.field(n, t) for t, n in zip(*jaccard_join._kinds(getattr(jaccard_join, name)))])
             for name in ("SENT", "COUNTED", "SHARED")}
    sent = pa.concat_tables(pa.Table.from_batches(list(jaccard_join.prefix_codes(iter([b]), True)), kinds["SENT"]) for b in batches)
    counted = runs(jaccard_join.shared_codes, kinds["COUNTED"], sent, ["key", "class"])
    got = runs(jaccard_join.class_sums, kinds["SHARED"], counted, ["class"]).to_pylist()

    sets = {set_code(c): set(c.tolist()) for c in shingle_sets(texts) if len(c)}
    often = collections.Counter(code for s in sets.values() for code in s)
    least = {name: sum(often[c] > 1 for c in s) for name, s in sets.items()}
    sums = {r["class"]: r["shared"] for r in got if r["shared"] is not None}
    assert len(sums) == sum(r["shared"] is not None for r in got)
    # A code that several sends hold twice is counted for each; none is missed, and none is made up.
    assert all(sums.get(name, 0) >= n and (n > 0 or name not in sums) for name, n in least.items())
    docs = collections.Counter((r["doc_id"], r["n"]) for r in got if r["n"] is not None)
    assert docs == collections.Counter((i, len(c)) for (i, _), c in zip(rows, shingle_sets(texts)))


def test_counts_of_many_classes_leave_a_task_in_few_rows():
    """Twelve tasks that each meet codes of all classes send a row for a bucket of classes, not for each class."""
    classes, buckets = np.arange(1, 1001), 7
    sums = collections.Counter()
    for task in range(12):
        codes = task * 1000 + np.arange(20)
        sent = pa.record_batch([pa.array([0], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, pa.array([np.repeat(codes, 1000).tobytes()]),
                                pa.array([np.tile(classes, 20).tobytes()])], list(jaccard_join._kinds(jaccard_join.SENT)[1]))
        counted = list(jaccard_join.shared_codes(iter([sent]), buckets))
        assert sum(len(b) for b in counted) <= buckets
        for r in itertools.chain.from_iterable(b.to_pylist() for b in jaccard_join.class_sums(iter(counted))):
            sums[r["class"]] += r["shared"]
    assert sums == {c: 240 for c in range(1, 1001)}


def test_codes_leave_a_task_in_few_rows():
    """The codes of a range are one row; 59 shingles of each of 100 texts were 5,900 rows."""
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array([prose(i, 63) for i in range(100)])], ["doc_id", "text"])
    sent = pa.Table.from_batches(list(jaccard_join.prefix_codes(iter([batch]), True, 16)))
    codes = sent.filter(sent["codes"].is_valid())
    assert codes["key"].to_pylist() == sorted(set(codes["key"].to_pylist())) and len(codes) <= 16
    sets = [c for c in shingle_sets(batch["text"].to_pylist())]
    assert sum(len(c) // 8 for c in codes["codes"].to_pylist()) == len(set().union(*[c.tolist() for c in sets]))


def test_trees_find_all_links_of_a_group():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 200 - 10 * (i % 12), replace=False),
                                      rng.integers(0, 1 << 63, 5 * (i % 9), dtype=np.uint64)])) for i in range(90)]
    linked = {(a, b) for a, b in itertools.combinations(range(90), 2)
              if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    found = tree_links(sets, np.arange(90), 3, 4)
    assert {tuple(sorted(x)) for x in found} <= linked

    def groups(pairs):
        up = list(range(90))
        for _ in range(90):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(found) == groups(linked)
    assert tree_links(sets, np.zeros(90, int), 3, 4) == []


def test_word_codes_follow_words():
    texts = ["a b  c\n", "", "c b a", "x" * 3_000_000 + " a", "b\x0bc\x1cd"]
    codes = list(word_codes([t.encode() for t in texts]))
    assert [len(c) for c in codes] == [3, 0, 3, 2, 2]
    assert codes[0].tolist() == codes[2][::-1].tolist() and codes[3][1] == codes[0][0]
    assert len(set(codes[0].tolist())) == 3
    assert [len(s) for s in shingle_sets(["A b c d e f", None, "a B c d e f", "a b"])] == [2, 0, 2, 1]


def hits(text, items):
    gap = "[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words(text, gap)
    hit, found = set(), set()
    for item, item_text in items:
        v = words(item_text, gap)
        n = min(13, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if v and tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    names = ",".join(sorted(map(str, found)))
    return (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


def test_winnowing_finds_every_shared_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (3, prose(3, 12)), (4, "Two words"), (5, None), (6, "..."), (7, ""),
             (10, prose(1, 40)), (11, "same same same same same same same same same same same same same same same")]
    rows = [(0, prose(1, 40)), (1, prose(9, 70) + " " + prose(1, 40)[40:] + " " + prose(8, 300)), (2, None), (3, ""),
            (4, prose(2, 12) + " " + prose(2, 13)), (5, prose(3, 12).upper().replace(" ", "-")), (6, "x two, WORDS two"),
            (7, "same " * 100), (8, prose(20, 200)), (8, prose(20, 200)), (None, prose(2, 13)), (None, prose(2, 13)),
            (9, prose(30, 51) + " " + prose(1, 30) + " " + prose(31, 60)), (9, "another text of the same id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = as_docs(spark, rows).selectExpr("*", "1 as words", "2 as window", "3 as first", "4 as size")
    want = multiset((i, *hits(t, items)) for i, t in rows)
    for most in (20_000, 0):  # with the benchmark's fingerprints at hand, and beyond that bound
        monkeypatch.setattr(decontaminate, "MOST_LITERALS", most)
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
        got = decontaminate.contaminated(docs, bench).collect()
        assert multiset((r.doc_id, r.n_words, r.n_hit, len(r["items"]),
                         hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
                        for r in got) == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert multiset((r.doc_id, r.text) for r in clean.collect()) == multiset(
        r for r in rows if not hits(r[1], items)[4])
    none = decontaminate.contaminated(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.n_hit for r in none)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("module", [decontaminate, jaccard_join])
def test_queries_equal_their_sql(spark, sample, module):
    assert oracle_check.compare(spark, oracle_check.connect(sample), module.NAME, sample).startswith("ok")

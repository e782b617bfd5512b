"""Base rules by brute force, and what both models keep of labelled documents."""

import collections
import re

import numpy as np
from corpus_rows import LABELS, as_docs, prose

from wattmill.llm import neighbour_vote, ngram_ratio
from wattmill.llm.common import read_table
from wattmill.llm.grams import gram_buckets, gram_counts

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0D]+", text) if x]
    runs = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), again, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def rows():
    clean = [(i, prose(i, 50 + i)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "%%%#" for w in prose(200 + i, 60).split())) for i in range(25)]
    odd = [(200, None), (201, ""), (202, "a b"), (203, "é" * 9 + " \u2003 x\x1cy"), (204, "same line\nsame line\n \n \n"),
           (205, "a b c d e f " * 30), (206, prose(5, 30) + " " + prose(5, 30)), (None, prose(400, 40)), (1, prose(1, 51)),
           (1, prose(1, 51))]
    return clean, junk, odd


def labels(spark):
    clean, junk, _ = rows()
    return spark.createDataFrame([(i, 1, 0) for i, _ in clean[:40]] + [(i, 0, 0) for i, _ in junk[:20]]
                                 + [(0, 1, 0), (39, 0, 0), (None, 1, 0), (59, None, None), (58, 1, 1)], LABELS)


def test_base_rules_equal_brute_force(spark):
    clean, junk, odd = rows()
    every = clean + junk + odd
    docs = as_docs(spark, every).selectExpr("*", "'clash' as n_words", "'x' as rules", "1 as trusted", "2 as kept")
    got = ngram_ratio.judged(docs, labels(spark)).collect()
    text_of = collections.defaultdict(set)
    for i, t in every:
        text_of[i].add(base(t))
    assert len(got) == len(every) and all(tuple(r[c] for c in RULES) in text_of[r.doc_id] for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in junk}
    assert not kept & {200, 201, 202, 204, 205, 206}
    stay = ngram_ratio.kept_documents(docs, labels(spark))
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == kept


def test_without_trusted_documents_the_base_rules_decide(spark):
    docs = as_docs(spark, rows()[0] + rows()[2])
    got = ngram_ratio.judged(docs, labels(spark).limit(0)).collect()
    assert all(r.kept != r.base_failed and r.log_ratio == 0 for r in got)
    assert ngram_ratio.judged(docs.limit(0), labels(spark)).count() == 0


def test_rules_keep_good_documents_and_drop_bad_ones(spark, sample):
    judged = ngram_ratio.query(spark, "/root/testdata/sf0.01").join(
        read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").toPandas()
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_neighbours_score_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = neighbour_vote.query(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held.score.between(0, 1).all() and (held.predicted == held.quality).mean() > 0.9
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    assert sum((good > b).sum() for b in bad) / (len(good) * len(bad)) > 0.97


def test_every_text_gets_a_score(spark):
    clean, junk, odd = rows()
    docs = as_docs(spark, clean + junk + odd).selectExpr("*", "'x' as score", "7 as label", "8 as labelled_id")
    got = neighbour_vote.scored(docs, labels(spark)).collect()
    assert len(got) == len(clean + junk + odd) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i, _ in clean if i != 39) > 0.5 > max(scores[i] for i, _ in junk)
    kept = neighbour_vote.kept_documents(docs, labels(spark))
    assert kept.columns == docs.columns
    assert {r.score for r in neighbour_vote.scored(docs, labels(spark).limit(0)).collect()} == {0.5}
    assert neighbour_vote.scored(docs.limit(0), labels(spark)).count() == 0


def test_votes_equal_brute_force(spark):
    """Every document against every labelled one: one cosine at a time, sorted, the nearest vote."""
    clean, junk, odd = rows()
    every = clean + junk + odd
    docs = as_docs(spark, every)
    model = neighbour_vote.fit(docs, labels(spark))
    assert 2 * neighbour_vote.NEIGHBOURS < len(model.labels) == len(model.vectors)

    def vector(text):
        x = neighbour_vote.features([text])[0].astype(np.float64)
        grams, repeats = x[:-neighbour_vote.PATTERNS] * model.rarity, x[-neighbour_vote.PATTERNS:]
        size = np.sqrt(sum(g * g for g in grams))
        if not size and not repeats.any():
            return None
        v = np.concatenate([grams / max(size, 1e-9), repeats]) @ model.axes
        return v / max(np.sqrt(sum(e * e for e in v)), 1e-9)

    def score(text):
        v = vector(text)
        if v is None:
            return model.share
        near = sorted(((float(v @ w), label) for w, label in zip(model.vectors, model.labels)), key=lambda x: -x[0])
        votes = [(max(c, 0.0) ** neighbour_vote.SHARPNESS, label) for c, label in near[:neighbour_vote.NEIGHBOURS]]
        return (sum(w * label for w, label in votes) + 0.1 * model.share) / (sum(w for w, _ in votes) + 0.1)

    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.score) for r in neighbour_vote.scored(docs, labels(spark)).collect())
    want = sorted((i is None, i or 0, t or "", score(t)) for i, t in every)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-3


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbour_vote, "SAMPLE", 10)
    clean, junk, _ = rows()
    model = neighbour_vote.fit(as_docs(spark, clean + junk), labels(spark))
    assert len(model.labels) == 10


def test_grams_cover_long_texts(monkeypatch):
    text = prose(1, 400)
    whole = gram_counts(text, 12)
    monkeypatch.setattr("wattmill.llm.grams.SLICE", 100)
    assert (gram_counts(text, 12) == whole).all() and whole.sum() == len(text) - 2
    assert not list(gram_buckets(None, 12)) and not list(gram_buckets("ab", 12))


def test_ratio_equals_plain_counting(spark, monkeypatch):
    """n-grams counted one by one in a dict of their buckets, with slices, merges and sends in between."""
    monkeypatch.setattr(ngram_ratio, "MERGE", 50)
    monkeypatch.setattr(ngram_ratio, "MOST_HELD", 200)
    clean, junk, odd = rows()
    every, good, size = clean + junk + odd, set(range(39)), ngram_ratio.SIZE
    buckets = int(np.ceil(ngram_ratio.ROOT * np.sqrt(sum(len((t or "").encode()) for _, t in every))))

    def grams(text):
        raw = (text or "").encode()
        return collections.Counter(raw[i:i + size] for i in range(len(raw) - size + 1))

    def bucket(gram):
        code = int.from_bytes(gram, "big")
        return ((((code ^ code >> 29) * 0x9E3779B97F4A7C15) % 2 ** 64 >> 32) * buckets) >> 32

    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in every:
        for g, n in grams(t).items():
            raw[bucket(g)] += n
            trusted[bucket(g)] += n * (i in good)
    share = sum(trusted.values()) / sum(raw.values())
    docs = as_docs(spark, every).repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, round(r.log_ratio, 4)) for r in ngram_ratio.judged(
        docs, labels(spark)).collect())
    want = collections.Counter()
    for i, t in every:
        n = grams(t)
        total = sum(c * np.log((trusted[bucket(g)] + share) / (raw[bucket(g)] + 1) / share) for g, c in n.items())
        want[i, base(t)[0], round(float(total / n.total()) if n else 0.0, 4)] += 1
    assert got == want


def test_table_grows_with_the_corpus(spark):
    clean = rows()[0]
    sizes = [len(ngram_ratio.ratio_table(as_docs(spark, clean * k), labels(spark))) for k in (1, 4, 16)]
    assert sizes[1] >= 2 * sizes[0] - 2 and sizes[2] >= 2 * sizes[1] - 2

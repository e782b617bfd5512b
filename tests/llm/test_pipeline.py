"""The pipeline: every stage works on what the one before kept, and its decisions take effect."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from corpus_rows import as_docs, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattmill.llm import decontaminate, jaccard_join, neighbour_vote, ngram_ratio
from wattmill.llm.common import read_table, written


def test_stages_narrow_the_documents(spark, sample):
    docs = read_table(spark, sample, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sample), f"test-{name}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing"]
    for before, after in zip(kept, kept[1:-1]):
        assert after.columns == docs.columns
        assert after.exceptAll(before).isEmpty() and after.count() <= before.count()
    labels, bench = read_table(spark, sample, "labels"), read_table(spark, sample, "benchmark")
    scored = neighbour_vote.scored(docs, labels).filter(F.col("score") >= neighbour_vote.CUT)
    assert {r.doc_id for r in scored.collect()} == {r.doc_id for r in kept[1].collect()}
    passed = ngram_ratio.judged(kept[1], labels).filter("kept")
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in kept[2].collect()}
    firsts = jaccard_join.similar_documents(kept[2]).filter("doc_id = component_id")
    assert {r.doc_id for r in firsts.collect()} == {r.doc_id for r in kept[3].collect()}
    clean = decontaminate.contaminated(kept[3], bench).filter("not contaminated")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept[4].collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[4].collect()}
    got = {r.doc_id: r.n for r in kept[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want and np.all([r.length <= 1024 for r in kept[5].collect()])


def test_stages_take_empty_and_odd_documents(spark, sample):
    odd = as_docs(spark, [(1, None), (2, ""), (None, prose(1, 80)), (3, prose(2, 60)), (3, prose(2, 60))])
    extra = odd.selectExpr("*", "1 as score", "'x' as kept", "2 as class", "3 as window")
    for docs in (extra, extra.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, docs, sample), f"odd-{name}")
            assert after.columns == docs.columns and after.count() <= docs.count()

"""Benchmark decontamination by winnowing: shared fingerprints, extended to whole windows.

A text becomes words (A-Z lower-cased). Of each `SPAN` consecutive k-grams the one with the smallest hash is kept, so two
texts that share `WINDOW` words in a row keep a common fingerprint inside them. Fingerprints of the documents that no
benchmark item has are dropped at once; the rest carry the few words around them and are extended: each window of
`WINDOW` words over a shared fingerprint is looked up among the windows of the items, word for word. So every shared
window is found, and nothing else. Items with fewer words than a window are one window of their own length; for each
such length the documents' runs of that length are looked up directly.

Long documents are cut into blocks that overlap by a window, so no row holds more than a block. Up to
`MOST_LITERALS` fingerprints of the benchmark are looked up where the document lies, and only its hits leave the row;
beyond that number both sides are shuffled by fingerprint. Benchmark tables are broadcast only while they are small
(`MOST_BROADCAST` rows, counted first) and shuffled beyond that.

A null or empty text has no words and is clean. Repeated rows are judged alike, each in a row of its own. Items without
words match nothing; equal items all count. Other columns are not read. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.functions.steps import staged
from wattmill.llm.common import fits, read_table, written

NAME = "op2_decontaminate"
WINDOW = 13  # words of a window
GRAM = 8  # words of a fingerprint
SPAN = WINDOW - GRAM + 1  # consecutive k-grams of which one is kept
BLOCK = 4096  # words of a document in one row
MOST_BROADCAST = 200_000  # rows of a benchmark table that is broadcast
MOST_LITERALS = 20_000  # fingerprints of the benchmark that are looked up inside a document's row
SPAN_TYPE = "struct<first:int,size:int,window:string>"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, GAPS), "")


def gram_hashes(words: Column) -> Column:
    """Hash of each run of GRAM words, from hashes of words, pairs and so on; empty for fewer words."""
    hashes, run = F.transform(words, lambda w: F.xxhash64(w)), 1
    while run < GRAM:
        hashes = F.zip_with(hashes, F.slice(hashes, run + 1, BLOCK + WINDOW), lambda x, y: F.xxhash64(x, y))
        run *= 2
    return F.slice(hashes, 1, F.greatest(F.size(words) - GRAM + 1, F.lit(0)))


def is_kept(j: Column) -> Column:
    """Is the k-gram at j the smallest of some SPAN consecutive ones?"""
    starts = F.sequence(F.greatest(j - (SPAN - 1), F.lit(0)), F.least(j, F.size("hashes") - SPAN))
    return F.exists(starts, lambda i: F.array_min(F.slice("hashes", i + 1, SPAN)) == F.get("hashes", j))


def hashed(blocks: DataFrame) -> DataFrame:
    return staged(blocks, {"hashes": gram_hashes(F.col("words"))})


def kept_places(wanted=None) -> Column:
    """Places of the kept k-grams, of those only whose hash is in `wanted` if given."""
    places = F.sequence(F.lit(0), F.size("hashes") - 1)
    known = (lambda j: is_kept(j)) if wanted is None else (
        lambda j: F.get("hashes", j).isin(wanted) & is_kept(j))
    return F.when(F.size("hashes") >= SPAN, F.filter(places, known)).otherwise(F.array().cast("array<int>"))


def spans_over(j: Column) -> Column:
    """The windows that hold the whole k-gram at j."""
    starts = F.sequence(F.greatest(j - (SPAN - 1), F.lit(0)), F.least(j, F.size("words") - WINDOW))
    return F.transform(starts, lambda i: span_at(i, WINDOW))


def span_at(i: Column, size: int) -> Column:
    return F.struct((F.col("first") + i).alias("first"), F.lit(size).alias("size"),
                    F.array_join(F.slice("words", i + 1, size), " ").alias("window"))


def all_spans(size: int) -> Column:
    """Every run of `size` words."""
    places = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: span_at(i, size))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size and text of each distinct window of each item with words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    return items.select("item_id", size.alias("size"), F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - size),
        lambda i: F.array_join(F.slice("words", i + 1, size), " "))).alias("window")).distinct()


def document_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of words: key, n_words of the document, first (place of the block), words."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("all_words"))
    cuts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("all_words") - 1, F.lit(0)), F.lit(BLOCK)),
        lambda i: F.struct(i.alias("first"), F.slice("all_words", i + 1, BLOCK + WINDOW - 1).alias("words")))
    return words.select(*KEY, F.size("all_words").cast("long").alias("n_words"), F.explode(cuts).alias("b")).select(
        *KEY, "n_words", "b.first", "b.words")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, MOST_BROADCAST) else df


def window_prints(windows: DataFrame) -> DataFrame:
    """print: the kept k-gram hashes of the full windows; (size, print): the whole hash of shorter ones."""
    full = hashed(windows.filter(F.col("size") == WINDOW).select("size", F.split("window", " ").alias("words")))
    return full.select("size", F.explode(F.transform(kept_places(), lambda j: F.get("hashes", j))).alias("print")) \
        .unionByName(windows.filter(F.col("size") < WINDOW).select("size", F.xxhash64("window").alias("print"))).distinct()


def has_print(known: list[int]):
    return lambda x: F.xxhash64(x["window"]).isin(known)


def by_known_prints(blocks: DataFrame, prints: dict[int, list[int]]) -> DataFrame:
    """Spans of the blocks over fingerprints in `prints` (by window size); a null span for each document."""
    found = [F.when(F.col("first") == 0, F.array(F.lit(None).cast(SPAN_TYPE))).otherwise(
        F.array().cast(f"array<{SPAN_TYPE}>"))]
    for size, known in sorted(prints.items()):
        if size == WINDOW:
            found.append(F.flatten(F.transform(kept_places(known), spans_over)))
            continue
        found.append(F.filter(all_spans(size), has_print(known)))
    return hashed(blocks).select(*KEY, "n_words", F.explode(F.concat(*found)).alias("s")).select(*KEY, "n_words", "s.*")


def by_joined_prints(blocks: DataFrame, prints: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for any number of fingerprints: those of the blocks are shuffled to those of the benchmark."""
    found = [blocks.filter("first = 0").select(*KEY, "n_words", F.lit(None).cast(SPAN_TYPE).alias("s"))]
    for size in sizes:
        known = prints.filter(F.col("size") == size).select("print")
        if size == WINDOW:
            marks = F.transform(kept_places(), lambda j: F.struct(
                F.get("hashes", j).alias("print"), spans_over(j).alias("spans")))
            rows = hashed(blocks)
        else:
            marks = F.transform(all_spans(size), lambda x: F.struct(
                F.xxhash64(x["window"]).alias("print"), F.array(x).alias("spans")))
            rows = blocks
        found.append(rows.select(*KEY, "n_words", F.explode(marks).alias("m")).select(*KEY, "n_words", "m.*").join(
            known, "print", "left_semi").select(*KEY, "n_words", F.explode("spans").alias("s")))
    return reduce(DataFrame.unionByName, found).select(*KEY, "n_words", "s.*")


def shared_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document row (`window` null) and per occurrence of a benchmark window in it (first, size, window)."""
    blocks, prints = document_blocks(docs), window_prints(windows)
    texts = windows.select("window", F.lit(True).alias("known")).distinct()
    if fits(prints, MOST_LITERALS):
        known: dict[int, list[int]] = {}
        for row in prints.collect():  # of the benchmark, and no more than MOST_LITERALS
            known.setdefault(row["size"], []).append(row["print"])
        spans = by_known_prints(blocks, known)
    else:
        sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most WINDOW values
        spans = by_joined_prints(blocks, prints, sizes)
    return spans.join(small(texts), "window", "left").filter("window is null or known").drop("known")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """One row per document row: text_hash, n_words, n_hit, items (sorted strings), contaminated.

    contaminated: at least one word is hit, and `share` times the hit words reach the words of the document.
    """
    windows = written(benchmark_windows(benchmark), "windows")
    hits = written(shared_windows(docs, windows), "hits")

    ends = F.aggregate(
        F.array_sort(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("first", "size")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["first"] + s["size"]).alias("end"),
            (a["hit"] + F.greatest(F.lit(0), s["first"] + s["size"] - F.greatest(a["end"], s["first"]))).alias("hit")))
    rows = hits.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.count_if(F.col("window").isNull()).alias("copies"),
                                  ends["hit"].cast("long").alias("n_hit"))

    # Windows of one document mostly belong to the same items: a set of items is known by its size and two hashes.
    sets = windows.groupBy("window").agg(F.struct(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("a"),
        F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("b")).alias("item_set"))
    shown = sets.groupBy("item_set").agg(F.min("window").alias("window"))
    members = shown.join(windows.select("window", "item_id").distinct(), "window").select("item_set", "item_id")
    items = (hits.filter("window is not null").join(small(sets), "window").select(*KEY, "item_set").distinct()
             .join(small(members), "item_set").groupBy(*KEY)
             .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    items = items.select(F.col("doc_id").alias("item_doc"), F.col("text_hash").alias("item_hash"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("item_doc")) & F.col("text_hash").eqNullSafe(F.col("item_hash"))
    return rows.join(items, same, "left").select(
        *KEY, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = contaminated(docs, benchmark).filter("contaminated and copy = 1").select(
        F.col("doc_id").alias("bad_doc"), F.col("text_hash").alias("bad_hash"))
    bad = written(bad, "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"])
    return docs.join(small(bad), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _words_sql(table: str, key: str) -> str:
    return (f"SELECT {key}, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), "
            f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAPS}'), lambda x: x <> '') AS w FROM {table}")


SQL = f"""
WITH d AS ({_words_sql('documents', 'doc_id')}),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM ({_words_sql('benchmark', 'item_id')}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT d.rid, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) AS s WHERE len(d.w) >= s.n)),
h AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)
"""

"""Similarity join on word shingles: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Equal sets are one class, known by a code of 63 bits; all else works on classes.

1. Filter. Of a set of n codes the lowest n - ceil(0.75 n) + l can be chosen so that two linked sets share at least l of
   them (l grows with n). Tasks send these codes to tasks by range of codes, a range in one row, each code once (a code
   that a task has seen in two classes needs no more); the counts of a bucket of classes come back in one row. A class is
   dropped unless enough of its codes are in another class too. A second round over the classes left asks for 0.75 n
   shared codes among all n. Both rounds drop only what cannot be linked.
2. Signature trees. Classes left meet in bounded groups by minimum codes, and a tree of signatures (signature_tree.py)
   joins each group. Connected components of these links come next.
3. Completion. With the rarest codes first, two linked classes share a code among the first n - ceil(0.75 n) + 1 of each.
   A code all of whose classes are in one component is done; codes with the same classes are looked at once. Classes that
   the codes left connect are families; a family meets by bands of size in signature trees, a large one in pairs of
   chunks that a code connects; then components once more.

So every link is found, or lies inside a component already. A component is named by its smallest doc_id.

A null or empty text has no shingles and is linked with nothing; its component is its own doc_id. Repeated rows are in
one class and each keep a row. Null doc_ids are linked like others, but never name a component unless all its doc_ids are
null. Other columns are not read; `representatives` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.common import checkpointed, fits, in_small_batches, read_table, shuffle_width, written
from wattmill.llm.signature_tree import tree_links
from wattmill.llm.word_codes import mixed, set_code, shingle_sets

NAME = "op7_jaccard_join"
# All links by a join on shingles, components by walking along them.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM w),
t AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
l AS (
  SELECT a.rid AS x, b.rid AS y FROM t AS a JOIN t AS b ON a.g = b.g AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rid, rid AS y FROM s UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.y)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.g)) AS n_shingles, min(e.doc_id) AS component_id
FROM s JOIN r USING (rid) JOIN s AS e ON e.rid = r.y GROUP BY s.rid
"""
P, Q = 3, 4  # least similarity P / Q
GROUP = 512  # classes in a task's group
GROUP_CODES = 2_000_000  # codes in a task's group
HELD_CODES = 1_000_000  # codes, or counts of classes, a task holds before it sends them
RANGES = 1 << 12  # of codes, at least; a task looks at the codes of one range together
GATHERED = 1 << 16  # rows of an Arrow batch that are looked at together
MOST_BROADCAST = 2_000_000  # ids that are broadcast
SEVERAL = -1  # owner of a code that a task has seen in two classes or more


def least_overlap(n: Column) -> Column:
    """ceil(P n / Q): shingles that a linked set shares at least."""
    return F.expr(f"({P} * n + {Q - 1}) div {Q}")


def spare(n: int) -> int:
    """Codes that two linked sets of this size or more share in their prefixes."""
    return max(1, n // 8)


def _kinds(schema: str) -> tuple[list, list[str]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32())}
    names, types = zip(*[f.split(" ") for f in schema.split(", ")])
    return [kinds[t] for t in types], list(names)


SENT = "key int, class long, doc_id long, n long, codes binary, owners binary"
COUNTED = "bucket int, doc_id long, class long, n long, classes array<long>, counts array<int>"
SHARED = "doc_id long, class long, n long, shared long"


def _batches(schema: str, columns: list) -> Iterator[pa.RecordBatch]:
    """Columns (None: nulls) as Arrow batches of GATHERED rows at most."""
    kinds, names = _kinds(schema)
    size = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(size, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k)
              for c, k in zip(columns, kinds)]
    whole = pa.record_batch(arrays, names)
    for at in range(0, size, GATHERED):
        yield whole.slice(at, GATHERED)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GATHERED rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sum of their counts."""
    found, at = np.unique(ids, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def range_of(codes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each code, from 0 to ranges - 1, ascending with the codes."""
    return ((codes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def pieces(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """64-bit values from each cut to the next as one binary value."""
    offsets = np.append(cuts, len(values)).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def prefix_codes(batches: Iterator[pa.RecordBatch], whole: bool, ranges: int = RANGES) -> Iterator[pa.RecordBatch]:
    """Rows SENT of documents (n is the size of the set), of codes (n is null) and of counts (n is negative).

    A task holds HELD_CODES codes; of these a code in two classes is counted for both and sent once, for SEVERAL. The
    codes of a range go in one row, with the class of each.
    """
    held: dict[int, np.ndarray] = {}
    size = 0

    def code_rows() -> Iterator[pa.RecordBatch]:
        owners = np.repeat(np.array(list(held), np.int64), [len(c) for c in held.values()])
        codes = mixed(np.concatenate(list(held.values())))
        order = np.argsort(codes, kind="stable")
        codes, owners = codes[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        often = np.diff(np.append(first, len(codes)))
        ids, counts = np.unique(owners[np.repeat(often > 1, often)], return_counts=True)
        yield from _batches(SENT, [range_of(mixed(ids.view(np.uint64)), ranges), ids, None, -counts, None, None])
        codes, owners = codes[first], np.where(often > 1, SEVERAL, owners[first])
        place = range_of(codes, ranges)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        yield from _batches(SENT, [place[cuts], None, None, None, pieces(codes, cuts), pieces(owners, cuts)])

    for batch in batches:
        doc_ids = batch.column(0)
        classes, sizes = [], []
        for codes in shingle_sets(batch.column(1).to_pylist()):
            n = len(codes)
            name = set_code(codes) if n else None
            classes.append(name)
            sizes.append(n)
            if n and name not in held:
                held[name] = (codes if whole else codes[:n - (P * n + Q - 1) // Q + spare(n)]).copy()
                size += len(held[name])
            if size > HELD_CODES:
                yield from code_rows()
                held, size = {}, 0
        # Documents are dealt by class and doc_id, so that copies spread.
        ids = np.array([c or 0 for c in classes], np.uint64) ^ mixed(
            doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield from _batches(SENT, [range_of(mixed(ids), ranges), classes, doc_ids, sizes, None, None])
    if held:
        yield from code_rows()


def buckets_of(names: np.ndarray, parts: int) -> np.ndarray:
    """A bucket from 0 to parts - 1 for each name."""
    return (mixed(names.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def packed_counts(ids: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows COUNTED of classes and their counts: those of a bucket in one row, of GATHERED classes at most."""
    bucket = buckets_of(ids, parts)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, counts = bucket[order], ids[order], counts[order].astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = np.unique(np.concatenate([first, np.arange(0, len(ids), GATHERED)]))
    for at in range(0, len(cuts), 256):
        starts = cuts[at:at + 256]
        end = cuts[at + 256] if at + 256 < len(cuts) else len(ids)
        inside = slice(starts[0], end)
        offsets = np.append(starts, end) - starts[0]
        yield from _batches(COUNTED, [bucket[starts], None, None, None,
                                      pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[inside])),
                                      pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts[inside]))])


def shared_classes(codes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The class of each code that is in another class too, once for each of its codes."""
    order = np.lexsort((owners, codes))
    codes, owners = codes[order], owners[order]
    new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])])
    codes, owners = codes[new], owners[new]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    often = np.diff(np.append(first, len(codes)))
    return owners[np.repeat(often > 1, often) & (owners != SEVERAL)]


def shared_codes(batches: Iterator[pa.RecordBatch], parts: int = 1) -> Iterator[pa.RecordBatch]:
    """Of rows SENT, sorted by key: how many codes of each class are in another class too (rows COUNTED).

    A task meets codes of most classes, so a row for each class would make classes times tasks; a row here holds the
    counts of a bucket of classes. The codes of one range are held at a time.
    """
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, codes, owners = None, [], []

    def held_classes() -> np.ndarray:
        return shared_classes(np.frombuffer(b"".join(codes), np.uint64), np.frombuffer(b"".join(owners), np.int64))

    for batch in batches:
        n = batch.column("n")
        others, rows = batch.filter(n.is_valid()), batch.filter(n.is_null())
        docs, before = others.filter(pc.greater_equal(others["n"], 0)), others.filter(pc.less(others["n"], 0))
        if len(docs):
            names = docs["doc_id"].fill_null(0).to_numpy() ^ docs["class"].fill_null(0).to_numpy()
            yield from _batches(COUNTED, [buckets_of(names, parts), docs["doc_id"], docs["class"], docs["n"], None, None])
        found = [before["class"].to_numpy()]
        often_each = [-before["n"].to_numpy()]
        for place, some, whose in zip(rows["key"].to_pylist(), rows["codes"].to_pylist(), rows["owners"].to_pylist()):
            if place != key and codes:
                found.append(held_classes())
                often_each.append(np.ones(len(found[-1]), np.int64))
                codes, owners = [], []
            key = place
            codes.append(some)
            owners.append(whose)
        ids, counts = summed(np.concatenate([ids, *found]), np.concatenate([counts, *often_each]))
        if len(ids) > HELD_CODES:
            yield from packed_counts(ids, counts, parts)
            ids, counts = ids[:0], counts[:0]
    if codes:
        last = held_classes()
        ids, counts = summed(np.concatenate([ids, last]), np.concatenate([counts, np.ones(len(last), np.int64)]))
    if len(ids):
        yield from packed_counts(ids, counts, parts)


def class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows SHARED of rows COUNTED: documents as they are, and for its counts one row per class (more where a task
    meets more than HELD_CODES classes; `enough` adds them up)."""
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in _gathered(batches):
        docs, rows = batch.filter(batch["classes"].is_null()), batch.filter(batch["classes"].is_valid())
        if len(docs):
            yield from _batches(SHARED, [docs["doc_id"], docs["class"], docs["n"], None])
        if len(rows):
            ids, counts = summed(np.concatenate([ids, rows["classes"].flatten().to_numpy()]),
                                 np.concatenate([counts, rows["counts"].flatten().to_numpy()]))
        if len(ids) > HELD_CODES:
            yield from _batches(SHARED, [None, ids, None, counts])
            ids, counts = ids[:0], counts[:0]
    if len(ids):
        yield from _batches(SHARED, [None, ids, None, counts])


def shared_counts(docs: DataFrame, whole: bool) -> DataFrame:
    """Rows of (doc_id, class, n) for every document, and a row of (class, shared) per class: codes in others too.

    whole: all codes of a set are looked at, else the prefix that the filter needs. Rows are sorted by range by Spark,
    which can spill; the tasks go from range to range.
    """
    parts = shuffle_width(docs.sparkSession)
    ranges = max(RANGES, 4 * parts)
    sent = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: prefix_codes(batches, whole, ranges), SENT)
    counted = sent.repartitionById(parts, F.pmod("key", F.lit(parts))).sortWithinPartitions("key").mapInArrow(
        lambda batches: shared_codes(batches, parts), COUNTED)
    return counted.repartitionById(parts, F.col("bucket")).mapInArrow(class_sums, SHARED)


def class_table(rows: DataFrame) -> DataFrame:
    """class, n, first_doc (smallest doc_id) of every class."""
    return rows.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.min("doc_id").alias("first_doc"))


def enough(rows: DataFrame, need: Column) -> DataFrame:
    """Classes (class, n, first_doc) whose shared codes reach `need` (of n)."""
    counted = rows.filter("shared is not null").groupBy("class").agg(F.sum("shared").alias("shared"))
    return class_table(rows).join(counted, "class").filter(F.col("shared") >= need).drop("shared")


def only(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and text of one document of each class (more where doc_ids repeat)."""
    ids = classes.select(F.col("first_doc").alias("wanted")).distinct()
    ids = F.broadcast(ids) if fits(ids, MOST_BROADCAST) else ids
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")


def class_codes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, n, codes (ascending, as signed numbers) of the given classes."""
    kinds, names = _kinds("class long, n long, codes array<long>")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [c for c in shingle_sets(batch.column(1).to_pylist()) if len(c)]
            yield pa.record_batch([pa.array([set_code(c) for c in sets], kinds[0]),
                                   pa.array([len(c) for c in sets], kinds[1]),
                                   pa.array([c.view(np.int64) for c in sets], kinds[2])], names)

    made = only(docs, classes).mapInArrow(codes, "class long, n long, codes array<long>")
    return made.join(classes.select("class"), "class", "left_semi").dropDuplicates(["class"])


LINKS = "class long, other long"


def joined_groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """Verified links inside each group of `members` (keys, class, label, side, codes), found by signature trees."""
    kinds, names = _kinds(LINKS)
    parts = shuffle_width(members.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def links() -> pa.RecordBatch:
            classes, labels, sides, sets = zip(*held)
            found = tree_links(list(sets), np.array(labels), P, Q, np.array(sides))
            return pa.record_batch([pa.array([classes[a] for a, _ in found], kinds[0]),
                                    pa.array([classes[b] for _, b in found], kinds[1])], names)

        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))]))
            rest = batch.columns[len(keys):]
            for i, key in enumerate(ids):
                if key != current and held:
                    if len(held) > 1:
                        yield links()
                    held = []
                current = key
                held.append((rest[0][i].as_py(), rest[1][i].as_py(), rest[2][i].as_py(),
                             rest[3][i].values.to_numpy().view(np.uint64)))
        if len(held) > 1:
            yield links()

    return members.select(*keys, "class", "label", "side", "codes").repartition(parts, *keys).sortWithinPartitions(
        *keys, "class").mapInArrow(join, LINKS)


def minimum_groups(codes: DataFrame) -> DataFrame:
    """Links among classes that share a minimum code under one of two orders."""
    kinds, names = _kinds("turn int, low long, class long, n long")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn in (0, 1):
                low = [mixed(c.values.to_numpy().view(np.uint64) ^ np.uint64(turn * 0x5851F42D4C957F2D)).min()
                       for c in batch.column(2)]
                yield pa.record_batch([pa.array([turn] * len(low), kinds[0]),
                                       pa.array(np.array(low, np.uint64).view(np.int64), kinds[1]),
                                       batch.column(0), batch.column(1)], names)

    keyed = written(codes.mapInArrow(keys, "turn int, low long, class long, n long"), "minimum-keys")
    sizes = keyed.groupBy("turn", "low").agg(F.count("*").alias("members"), F.sum("n").alias("codes_in")) \
        .filter("members > 1").withColumn("chunks", F.expr(
            f"cast(greatest(ceil(members / {GROUP}), ceil(codes_in / {GROUP_CODES})) as int)"))
    chosen = keyed.join(sizes, ["turn", "low"]).select(
        "turn", "low", "class", F.pmod(F.xxhash64("class", "turn"), F.col("chunks")).alias("chunk"))
    members = chosen.join(codes.select("class", "codes"), "class").withColumns(
        {"label": F.col("class"), "side": F.lit(False)})
    return joined_groups(members, ["turn", "low", "chunk"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """class and label (smallest class that links reach) of every node, by smallest neighbours and pointer jumps."""
    both = checkpointed(links.select("class", "other").unionByName(
        links.select(F.col("other").alias("class"), F.col("class").alias("other"))).distinct())
    state = checkpointed(nodes.select("class", F.col("class").alias("label")))
    while True:
        near = both.join(state.select(F.col("class").alias("other"), "label"), "other").groupBy("class").agg(
            F.min("label").alias("near"))
        lower = state.join(near, "class", "left").select(
            "class", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jumps = lower.select(F.col("class").alias("label"), F.col("label").alias("further"))
        after = checkpointed(lower.join(jumps, "label").select("class", "was", F.col("further").alias("label")))
        if after.filter("was <> label").isEmpty():
            return after.select("class", "label")
        state = after.select("class", "label")


def open_groups(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """(group_id, class, label, n) of codes in the prefixes, rarest first, of classes of two components or more."""
    tokens = codes.join(labels, "class").select("class", "n", "label", F.explode("codes").alias("code"))
    often = tokens.groupBy("code").agg(F.count("*").alias("often")).filter("often > 1")
    of_class = Window.partitionBy("class")
    ranked = tokens.join(often, "code").select(
        "class", "n", "label", "code", F.count("*").over(of_class).alias("shared"),
        F.row_number().over(of_class.orderBy("often", "code")).alias("place"))
    prefix = ranked.filter(F.col("place") <= F.col("shared") - least_overlap(F.col("n")) + 1)
    prefix = written(prefix.select("class", "n", "label", "code"), "prefixes")
    groups = prefix.groupBy("code").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        F.struct(F.count("*"), F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64("class", F.lit(1)))).alias("who"))
    group_ids = groups.filter("low <> high").groupBy("who").agg(F.min("code").alias("code")).select("code")
    return prefix.join(group_ids, "code").withColumnRenamed("code", "group_id")


def families(opened: DataFrame) -> DataFrame:
    """class and family: classes that chains of open groups connect."""
    firsts = opened.groupBy("group_id").agg(F.min("class").alias("other"))
    chains = opened.join(firsts, "group_id").filter("class <> other").select("class", "other").distinct()
    return components(opened.select("class").distinct(), chains).withColumnRenamed("label", "family")


def placed_members(opened: DataFrame) -> DataFrame:
    """(family, band, chunk, chunks, class, label, side): classes by family, band of sizes and chunk of bounded size.

    A band holds the sets of its own sizes and, with `side`, those of the next band: linked sets are at most one band
    apart. Chunks keep components together where they can.
    """
    # Linked sizes differ by a factor of Q / P at most.
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(Q / P)) + 1e-9).cast("int")
    classes = opened.select("class", "n", "label").distinct().join(families(opened), "class")
    banded = classes.withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") - 1))).withColumn(
        "side", F.col("own") > F.col("band"))

    def parts(members: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Number of chunks of each group, for groups of two components or more."""
        full = F.expr(f"cast(greatest(ceil(2 * members / {GROUP}), ceil(2 * codes_in / {GROUP_CODES})) as int)")
        return members.groupBy(*keys).agg(
            F.count("*").alias("members"), F.sum("n").alias("codes_in"), F.min("label").alias("low"),
            F.max("label").alias("high"), F.bool_and("side").alias("upper_only"),
        ).withColumn(name, F.when(full <= 2, 1).otherwise(full))

    needed = parts(banded, ["family", "band"], "parts").filter("low <> high and not upper_only")
    chunked = banded.join(needed.select("family", "band", "parts"), ["family", "band"]).withColumn(
        "chunk", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int"))
    splits = parts(chunked, ["family", "band", "chunk"], "splits").select("family", "band", "chunk", "splits")
    return chunked.join(splits, ["family", "band", "chunk"]).select(
        "family", "band", "class", "label", "side", ((F.col("parts") > 1) | (F.col("splits") > 1)).alias("split"),
        F.struct("chunk", F.pmod(F.xxhash64("class"), F.col("splits")).cast("int").alias("part")).alias("chunk"))


def completed_links(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between classes of different components."""
    opened = written(open_groups(codes, labels), "open-groups")
    placed = written(placed_members(opened), "placed")
    keys = ["family", "band", "one", "two"]
    whole = placed.filter("not split").withColumns({"one": F.col("chunk"), "two": F.col("chunk")})
    # Of a family in several chunks only those pairs meet that an open group connects.
    split = placed.filter("split")
    seen = split.join(opened.select("class", "group_id"), "class").select("family", "band", "group_id", "chunk").distinct()
    pairs = seen.withColumnRenamed("chunk", "one").join(
        seen.withColumnRenamed("chunk", "two"), ["family", "band", "group_id"]).filter("one <= two").select(*keys).distinct()
    sides = pairs.withColumn("chunk", F.explode(F.array_distinct(F.array("one", "two"))))
    members = whole.unionByName(split.join(sides, ["family", "band", "chunk"])).select(*keys, "class", "label", "side")
    return joined_groups(members.join(codes.select("class", "codes"), "class"), keys)


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    first = written(shared_counts(docs, whole=False), "prefix-counts")
    need = F.greatest(F.lit(1), F.expr(f"(({P} * n + {Q - 1}) div {Q}) div 8"))
    likely = written(enough(first, need), "likely")
    second = written(shared_counts(only(docs, likely), whole=True), "whole-counts")
    classes = written(enough(second, least_overlap(F.col("n"))), "linked-classes")
    codes = written(class_codes(docs, classes), "class-codes")

    links = written(minimum_groups(codes), "tree-links")
    labels = components(codes, links)
    more = written(completed_links(codes, labels), "more-links")
    tops = components(labels.select(F.col("label").alias("class")).distinct(), more.join(
        labels, "class").select(F.col("label").alias("one"), "other").join(
        labels.select(F.col("class").alias("other"), F.col("label").alias("two")), "other").select(
        F.col("one").alias("class"), F.col("two").alias("other")))
    final = labels.select("class", F.col("label").alias("top")).join(
        tops.select(F.col("class").alias("top"), "label"), "top").select("class", "label")

    table = class_table(first)
    named = table.join(final, "class").groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of_class = table.join(final.join(named, "label").select("class", "component_id"), "class", "left").select(
        F.col("class").alias("of_class"), F.coalesce("component_id", "first_doc").alias("component_id"))
    rows = first.filter("n is not null").select("doc_id", F.col("n").alias("n_shingles"), "class")
    # Documents without shingles have no class; a key of their own spreads them.
    key = F.coalesce("class", -F.lit(1) - F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    return rows.withColumn("key", key).join(of_class, F.col("key") == F.col("of_class"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all its columns.

    Rows without shingles and rows without a doc_id all stay. Of rows with equal doc_id and text, one stays.
    """
    found = written(similar_documents(docs).filter("doc_id is not null"), "components")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = F.broadcast(gone) if fits(gone, MOST_BROADCAST) else gone
    kept = docs.join(gone, docs["doc_id"] == F.col("gone"), "left_anti")
    again = found.filter("n_shingles > 0 and doc_id = component_id").groupBy(
        F.col("doc_id").alias("again")).count().filter("count > 1").select("again")
    if again.isEmpty():
        return kept
    again = F.broadcast(again) if fits(again, MOST_BROADCAST) else again
    same = docs["doc_id"] == F.col("again")
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))



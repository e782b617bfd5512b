from frames import rows
from pyspark.sql import functions as F

from wattmill.operators import extract as ex
from wattmill.operators import spatial as sp
from wattmill.queries.views import bill_texts, sheets

TEXTS = [
    (1, "Energia bill\nenergia.ie"), (2, "Go Power bill. Go Power. Call ESB Networks"), (3, "alternergia and calorific"),
    (4, "   "), (5, "Electric\nIreland"), (6, "bord gáis"),
]


def test_provider_detection(spark):
    df = spark.createDataFrame(TEXTS, "bill_id int, text string")
    got = {r["bill_id"]: r["provider"] for r in ex.detect_provider(df).collect()}
    assert got == {1: "Energia", 2: "Go Power", 3: "unknown", 4: "unknown", 5: "Electric Ireland", 6: "Bord Gais"}


def test_safe_float_and_transforms(spark):
    df = spark.createDataFrame([("25.00 (calculated)", 25.0), ("1,234.50", 1234.5), ("-", None), ("1-2", None), ("€ 5.", 5.0), (None, None)],
                               "v string, want double")
    assert all(r[0] == r[1] for r in df.select(ex.safe_float(F.col("v")), "want").collect())


def test_merge_rules(spark):
    def f(v, c):
        return F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("value"), F.lit(c).alias("confidence"), F.lit(0).alias("pattern_index")))

    df = spark.createDataFrame([(1, "1,000.00", "1000.004"), (2, "a", "b"), (3, None, "b"), (4, "a", None)], "i int, a string, b string")
    keep = ex.merge_field(f("a", 0.8), f("b", 0.75), F.lit(False))
    got = rows(df.select("i", keep["value"].alias("v"), F.round(keep["confidence"], 2).alias("c")), "i")
    assert got == [(1, "1,000.00", 0.9), (2, "a", 0.8), (3, "b", 0.75), (4, "a", 0.8)]


def _words(spark, words):
    data = [("d", 1, 1, line, i + 1, left, top, 50, 20, 90.0, text) for i, (text, left, top, line) in enumerate(words)]
    return spark.createDataFrame(data, "doc_id string, page_num int, block_num int, line_num int, word_num int, left int, "
                                       "top int, width int, height int, conf double, text string")


def test_nearest_value_prefers_the_right(spark):
    df = _words(spark, [("Total", 10, 10, 1), ("due", 70, 10, 1), ("€55.00", 200, 10, 1), ("99.00", 70, 100, 2)])
    got = {r["field_name"]: r["value"] for r in sp.spatial_fields(df).collect()}
    assert got["total_incl_vat"] == "55.00"


def test_misread_label_and_value_below(spark):
    df = _words(spark, [("MPRM", 10, 10, 1), ("10000000001", 10, 40, 2)])
    got = {r["field_name"]: r["value"] for r in sp.spatial_fields(df).collect()}
    assert got == {"mprn": "10000000001"}


def test_value_of_the_wrong_kind_or_too_far(spark):
    far = _words(spark, [("MPRN", 10, 10, 1), ("10000000001", 10, 500, 2)])
    wrong = _words(spark, [("MPRN", 10, 10, 1), ("hello", 100, 10, 1)])
    assert sp.spatial_fields(far).count() == 0
    assert sp.spatial_fields(wrong).count() == 0


def test_one_pattern_counts_every_bounded_word(spark):
    import random
    import re

    words = ["go", "go power", "go power.ie", "power", "a b a", "bord gáis", "x.y"]
    random.seed(4)
    texts = ["".join(random.choices([*words, " ", " ", ".", "1", "go", "á", "ie"], k=random.randint(0, 12)))
             for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: {c.word: c.n for c in r.c} for r in df.select("i", ex.keyword_counts(F.col("t"), words).alias("c")).collect()}
    for i, text in enumerate(texts):
        # Overlaps of a word with itself count, as nothing is consumed.
        want = {w: len(re.findall(f"(?<![a-z0-9])(?={re.escape(w)}(?![a-z0-9]))", text)) for w in words}
        assert got[i] == {w: n for w, n in want.items() if n}


def test_rules_come_from_a_table(spark):
    """A made rule set, read beside plain Python; the plan does not grow with the rules."""
    import re

    from wattmill.operators import rules

    patterns = [("first", r"Ref (\d+)"), ("first", r"No (\w+)"), ("pair", r"(\d+) to (\d+)"), ("cut", r"Sum ([\d,]+)")]
    sets = [("k", [(f, [rules.option(p, 0.5 + i / 10, i, transform="strip_commas" if f == "cut" else None)
                        for i, (g, p) in enumerate(patterns) if g == f]) for f in ("first", "pair", "cut")]),
            ("m", [("days", [rules.option(r"(\d+) days @ ([\d.]+)", 0.9, 0, multi=True, groups={"days": 1, "rate": 2})]),
                   ("after", [rules.option(r"(\d+)", 0.9, 0, anchor="Total")])])]
    texts = [(1, "k", "no 7 Sum 1,200"), (2, "k", "Ref 12 No x"), (3, "k", "3 to 4"), (4, "k", None), (5, "none", "Ref 1"),
             (6, "m", "9 30 days @ 0.5 and 10 days @ 0.25 total 77"), (7, "m", "5")]
    df = spark.createDataFrame(texts, "i int, key string, text string")
    names = ["first", "pair", "cut", "days", "after"]
    got = {r.i: r.x and {f: r.x[f].value for f in names if r.x[f]} for r in
           rules.with_found(df, "text", F.col("key"), names, "x", sets).collect()}
    assert got == {1: {"first": "7", "cut": "1200"}, 2: {"first": "12"}, 3: {"pair": "3 - 4"}, 4: {}, 5: None,
                   6: {"days": "40 - 0.4375 - 17.50", "after": "77"}, 7: {}}
    index = rules.with_found(df, "text", F.col("key"), names, "x", sets).filter("i = 1").first().x.first
    assert (index.confidence, index.pattern_index) == (0.6, 1) and re.match(r"no (\w+)", texts[0][2])

    def size(many):
        more = [("k", sets[0][1] + [(f"f{i}", [rules.option(r"(\d)", 0.5, 0)]) for i in range(many)])]
        plan = rules.with_found(df, "text", F.col("key"), names, "x", more)._jdf.queryExecution().optimizedPlan()
        return len(plan.toString())

    assert abs(size(300) - size(0)) < 200


def test_words_never_hide_a_match(spark):
    """A text is searched by the options whose words it holds; each pattern is compiled once, not for every text."""
    import random
    import re

    import pyarrow as pa

    from wattmill.operators import flat_extract, rules

    assert rules.fixed_words(r"(?im)(?:Billing|Bill)\s*Period\s+Units?\s{2}(\d+)x{0,3} (at (?:the )?end)(?=no)") == ["period", "unit", "end", "at"]
    assert rules.fixed_words("one|two") == [] and rules.first_word("(?im)VATs?") == "" and rules.first_word(r"(?im)VAT\s*(\d)") == "vat"
    ready = [rules._ready(o) for sets in (rules.rule_sets(), flat_extract.flat_rules()) for _, fields in sets
             for _, options in fields for o in options]
    pieces = ["Total", "due", "VAT", "@", "9%", "€12.50", "\n", " ", "10000000001", "Account", "Number", "MCC", "3 May 2024", "to",
              "Standing Charge", "30 days", "KEROSENE", "İnvoice", "no", "Day", "Night", "Units at", "Date of this Bill", "DG1"]
    random.seed(3)
    texts = [random.choice([str, str.upper, str.lower])(" ".join(random.choices(pieces, k=25))).replace("k", "K")
             for _ in range(120)]
    hits = 0
    for text in texts:
        lower = rules.folded(text)
        for o in ready:
            want = o.pattern.search(text)
            seen = rules._search(text, lower, o) if all(w in lower for w in o.words) else None
            if not o.anchor:
                assert (want and want.span()) == (seen and seen.span()), (o, text)
                hits += want is not None
    assert hits > 500
    compiled, plain = [], re.compile
    find = rules._finder(rules.rule_sets(), ["mprn", "subtotal"])
    try:
        re.compile = lambda *a: compiled.append(a[0]) or plain(*a)
        find(pa.array(texts), pa.array(["Energia"] * len(texts)))
    finally:
        re.compile = plain
    assert len(compiled) == len(set(compiled)) > 0


def test_provider_words_of_a_made_list():
    import pyarrow as pa

    find = ex._provider_finder({"A": ["go", "go power"], "B": ["Go Power", "x.ie"]})
    texts = ["Go\n\tPower", "go x.ie go power x.ie", "agog go1", "GO go", None, ""]
    got = [(r["provider"], r["word"]) for r in find(pa.array(texts)).to_pylist()]
    assert got == [("A", "go power"), ("B", "Go Power"), (None, None), ("A", "go"), (None, None), (None, None)]


def test_words_stand_for_labels_and_values():
    assert sp.label_words_like("MPRM:") == {"mprn"} and "vat" in sp.label_words_like("(VAT") and not sp.label_words_like("10.50")
    hits = sorted((h["label"], h["start"], h["span"]) for h in sp._labels_of(["x", "Tota1", "due", "VAT", "@", "9%"]))
    assert hits == [("Total due", 1, 2), ("VAT", 3, 1), ("VAT @", 3, 2)]
    assert "subtotal" in sp.fitting_fields("€1,055.00") and "mprn" not in sp.fitting_fields("€1,055.00")
    assert {"mprn", "day_kwh"} <= set(sp.fitting_fields("10000000001")) and sp.fitting_fields("€ ") == ()


def test_words_of_a_document_are_shuffled_once(spark):
    # F3-F8: lines were made for text, labels, values and confidence each, and joined again.
    plan = sp.extract_spatial(_words(spark, [("MPRN:", 10, 10, 1), ("10000000001", 200, 10, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_documents_cut_by_arrow_batches(spark):
    one = _words(spark, [("MPRN:", 10, 10, 1), ("10000000001", 200, 10, 1), ("Total", 10, 60, 2), ("due", 80, 60, 2), ("12.00", 200, 60, 2)])
    many = spark.range(50).crossJoin(one.drop("doc_id")).withColumnRenamed("id", "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sp.documents(many).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {r.ocr_text for r in sp.documents(one).collect()}
    assert sorted(r.doc_id for r in got) == list(range(50)) and {r.ocr_text for r in got} == texts
    assert all({v.field_name: v.text for v in r["values"]}["mprn"] == "10000000001" for r in got)


def test_bills_of_one_split_are_read_by_all_tasks(spark):
    # F3-F8, F24, F26: one row group gave one task for all texts.
    texts = bill_texts(spark, "/root/testdata/sf0.001")
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sheet_rows_of_one_split_are_read_by_all_tasks(spark):
    # one row group gave one task for all cells.
    cells, _ = sheets(spark, "/root/testdata/sf0.001")
    assert cells.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

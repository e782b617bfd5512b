"""Which column of a spreadsheet is which standard field, in three tiers, over many files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattmill.constants import FIELD_ORDER, KNOWN_COLUMNS
from wattmill.functions.dates import with_dates
from wattmill.functions.numbers import to_number

FUZZY_THRESHOLD = 80.0
SAMPLE_ROWS, HIT_RATE, NUMERIC_SHARE = 50, 0.8, 0.5
KWH_MAX, COST_MAX = 500, 10000
# Confidence of a field guessed from cell contents, in the order fields are tried.
CONTENT_CONFIDENCE = {"datetime": 0.7, "mprn": 0.8, "import_kwh": 0.6, "cost": 0.5}
CANDIDATE = "struct<field:string,col_idx:int,column_name:string,tier:int,confidence:double,reason:string>"


def normalise_header(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "_-", "  ")


# ---------------------------------------------------------------- header similarity


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - bin(row).count("1")


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 of the two texts with their words sorted (insert/delete distance)."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return 200.0 * _common_subsequence(a, b) / total if total else 100.0


def _plain(name: str) -> str:
    return name.strip().lower().replace("_", " ").replace("-", " ")


_SCORES = T.ArrayType(
    T.StructType()
    .add("score", T.DoubleType())
    .add("rank", T.IntegerType())
    .add("field", T.StringType())
    .add("synonym", T.StringType())
    .add("exact", T.IntegerType())
)


@F.pandas_udf(_SCORES)
def _field_scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For a normalised header and each field: the most similar synonym, and the position of an equal one.

    `rank` is larger for earlier fields.  Headers repeat across files, so each text is scored once per task.
    """
    names = {field: [_plain(s) for s in synonyms] for field, synonyms in KNOWN_COLUMNS.items()}
    seen: dict[str, list[dict]] = {}

    def score(header: str) -> list[dict]:
        if header not in seen:
            out = []
            for rank, field in enumerate(FIELD_ORDER):
                best = max((token_sort_ratio(header, n), -i) for i, n in enumerate(names[field]))
                out.append({
                    "score": best[0], "rank": -rank, "field": field, "synonym": KNOWN_COLUMNS[field][-best[1]],
                    "exact": names[field].index(header) if header in names[field] else None,
                })
            seen[header] = out
        return seen[header]

    for batch in batches:
        yield batch.map(score)


def _no_candidates() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def _candidate(field: Column, column: Column, tier: int, confidence: Column, reason: Column) -> Column:
    return F.struct(
        field.alias("field"), column["col_idx"].alias("col_idx"), column["column_name"].alias("column_name"),
        F.lit(tier).alias("tier"), confidence.alias("confidence"), reason.alias("reason"),
    ).cast(CANDIDATE)


def _fields_of(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: c["field"])


def _names_of(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: c["column_name"])


def _profile(headers: DataFrame) -> DataFrame:
    """One row per file: its columns in order with their scores.  A file has few columns."""
    scored = headers.withColumn("scores", _field_scores(normalise_header(F.col("column_name"))))
    return scored.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "column_name", "scores"))).alias("columns")
    )


# ---------------------------------------------------------------- tier 1: exact


def _exact_rank(position: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(
        c["scores"][position]["exact"].alias("exact"), (-c["col_idx"]).alias("later"), c["column_name"]
    )


def _exact(columns: Column) -> Column:
    """Per field the first synonym in list order that equals a header; of equal headers the last column."""
    picks = []
    for position, field in enumerate(FIELD_ORDER):
        ranked = F.transform(columns, _exact_rank(position))
        best = F.array_min(F.filter(ranked, lambda r: r["exact"].isNotNull()))
        column = F.struct((-best["later"]).alias("col_idx"), best["column_name"].alias("column_name"))
        found = _candidate(F.lit(field), column, 1, F.lit(1.0), F.concat(F.lit("exact match: "), best["column_name"]))
        picks.append(F.when(best.isNotNull(), found))
    return F.filter(F.array(*picks), lambda c: c.isNotNull())


# ---------------------------------------------------------------- tier 2: fuzzy


def _fuzzy(columns: Column, exact: Column) -> Column:
    """Greedy by column order: each header not claimed exactly takes its most similar field not taken so far."""
    rest = F.filter(columns, lambda c: ~F.array_contains(_names_of(exact), c["column_name"]))

    def step(taken: Column, column: Column) -> Column:
        best = F.array_max(F.filter(column["scores"], lambda s: ~F.array_contains(_fields_of(taken), s["field"])))
        pick = _candidate(best["field"], column, 2, best["score"] / 100,
                          F.concat(F.lit("similar to: "), best["synonym"]))
        return F.when(best["score"] >= FUZZY_THRESHOLD, F.concat(taken, F.array(pick))).otherwise(taken)

    return F.aggregate(rest, _no_candidates(), step)


def _new_fields(found: Column, earlier: Column) -> Column:
    return F.filter(found, lambda c: ~F.array_contains(_fields_of(earlier), c["field"]))


def name_matches(headers: DataFrame) -> DataFrame:
    """(file_id, columns, exact, fuzzy, named): tiers 1 and 2; `named` keeps tier 2 only for new fields."""
    return (
        _profile(headers)
        .withColumn("exact", _exact(F.col("columns")))
        .withColumn("fuzzy", _fuzzy(F.col("columns"), F.col("exact")))
        .withColumn("named", F.concat("exact", _new_fields(F.col("fuzzy"), F.col("exact"))))
    )


def exact_matches(headers: DataFrame) -> DataFrame:
    return name_matches(headers).select("file_id", F.inline("exact"))


def fuzzy_matches(headers: DataFrame) -> DataFrame:
    return name_matches(headers).select("file_id", F.inline("fuzzy"))


# ---------------------------------------------------------------- tier 3: content


def looks_like_datetime(parsed: Column) -> Column:
    return F.avg(parsed.isNotNull().cast("int")) > HIT_RATE


def looks_like_mprn(value: Column) -> Column:
    return F.avg(F.trim(value).rlike(r"^10\d{8,9}$").cast("int")) > HIT_RATE


def _in_range(number: Column, top: int) -> Column:
    """Enough numbers, and most of them between 0 and `top`."""
    valid = F.count(number)
    inside = F.count_if(number.between(0, top))
    return F.coalesce((valid >= F.count("*") * NUMERIC_SHARE) & (F.try_divide(inside, valid) > HIT_RATE), F.lit(False))


def looks_like_kwh(value: Column) -> Column:
    return _in_range(to_number(value), KWH_MAX)


def looks_like_cost(value: Column) -> Column:
    return _in_range(to_number(F.regexp_replace(value, "[€$£,]", "")), COST_MAX)


def content_flags(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """What the first 50 filled cells of each wanted column look like; wanted(file_id, wanted ARRAY<INT>).

    `datetime` counts dates with the day first, `dated` all dates that cleaning reads: the rest with the month first.
    The rank limit is applied before the shuffle, so a file that owns most rows sends 50 cells per column and task.
    """
    cells = (
        rows.join(wanted, "file_id")
        .select("file_id", "row_idx", "wanted", F.posexplode("cells").alias("col_idx", "value"))
        .filter(F.array_contains("wanted", F.col("col_idx")) & F.col("value").isNotNull())
        .drop("wanted")
    )
    first = Window.partitionBy("file_id", "col_idx").orderBy("row_idx")
    sample = cells.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= SAMPLE_ROWS)
    value = F.col("value")
    parsed = with_dates(sample, {"parsed": "value"}, "day_first")
    parsed = parsed.withColumn("rest", F.when(F.col("parsed").isNull(), value))
    return with_dates(parsed, {"month_first": "rest"}, "month_first").groupBy("file_id", "col_idx").agg(
        looks_like_datetime(F.col("parsed")).alias("datetime"),
        looks_like_datetime(F.coalesce("parsed", "month_first")).alias("dated"),
        looks_like_mprn(value).alias("mprn"),
        looks_like_kwh(value).alias("import_kwh"),
        looks_like_cost(value).alias("cost"),
    )


def _content(flagged: Column, columns: Column, named: Column) -> Column:
    """Greedy by column order over columns no name claimed; a field is also closed when a claimed column
    carries the field's own name.
    """
    closed = _names_of(named)

    def step(taken: Column, flags: Column) -> Column:
        column = F.struct(
            flags["col_idx"].alias("col_idx"),
            F.get(F.filter(columns, lambda c: c["col_idx"] == flags["col_idx"]), F.lit(0))["column_name"]
            .alias("column_name"),
        )
        pick = F.lit(None).cast(CANDIDATE)
        for field, confidence in reversed(CONTENT_CONFIDENCE.items()):
            free = ~F.array_contains(_fields_of(taken), field) & ~F.array_contains(closed, field)
            found = _candidate(F.lit(field), column, 3, F.lit(confidence), F.lit(f"contents look like {field}"))
            pick = F.when(flags[field] & free, found).otherwise(pick)
        return F.when(pick.isNotNull(), F.concat(taken, F.array(pick))).otherwise(taken)

    return F.aggregate(flagged, _no_candidates(), step)


# ---------------------------------------------------------------- all tiers


def detect_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(file_id, candidates): one candidate per field, earlier tiers win.

    Cells are only looked at for files that still miss a field, and there only for columns no name claimed.
    """
    names = name_matches(headers)
    unclaimed = F.transform(
        F.filter("columns", lambda c: ~F.array_contains(_names_of(F.col("named")), c["column_name"])),
        lambda c: c["col_idx"],
    )
    missing = F.size(F.array_except(F.array(*[F.lit(f) for f in CONTENT_CONFIDENCE]), _fields_of(F.col("named"))))
    wanted = names.select("file_id", unclaimed.alias("wanted"), missing.alias("missing")).filter(
        (F.col("missing") > 0) & (F.size("wanted") > 0)
    )
    flags = content_flags(rows, wanted.drop("missing")).withColumn("datetime", F.col("dated")).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", *CONTENT_CONFIDENCE))).alias("flagged")
    )
    joined = names.join(flags, "file_id", "left").withColumn(
        "content", F.when(F.col("flagged").isNotNull(), _content(F.col("flagged"), F.col("columns"), F.col("named")))
        .otherwise(_no_candidates())
    )
    return joined.select(
        "file_id", F.concat("named", _new_fields(F.col("content"), F.col("named"))).alias("candidates")
    )


def candidate_rows(detected: DataFrame) -> DataFrame:
    """(file_id, field, col_idx, column_name, tier, confidence, reason)."""
    return detected.select("file_id", F.inline("candidates"))


def build_mapping(detected: DataFrame) -> DataFrame:
    """One row per file: the column chosen for each field, the highest tier used and the mean confidence."""
    found = F.col("candidates")

    def of(field: str) -> Column:
        return F.get(F.filter(found, lambda c: c["field"] == field), F.lit(0))

    total = F.aggregate(found, F.lit(0.0), lambda acc, c: acc + c["confidence"])
    return detected.select(
        "file_id",
        *[of(f)["column_name"].alias(f"{f}_col") for f in FIELD_ORDER],
        *[of(f)["col_idx"].alias(f"{f}_idx") for f in FIELD_ORDER],
        F.coalesce(F.array_max(F.transform(found, lambda c: c["tier"])), F.lit(0)).alias("detection_tier"),
        F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0)).alias("confidence"),
    )


def locate_columns(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """Give a mapping that only names columns (for example an edited one) their positions.

    Of columns with one name the first is taken.
    """
    firsts = headers.groupBy("file_id", "column_name").agg(F.min("col_idx").alias("col_idx"))
    by_name = firsts.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "col_idx")))
                                            .alias("at"))
    return mapping.join(by_name, "file_id", "left").withColumns(
        {f"{f}_idx": F.try_element_at("at", F.col(f"{f}_col")) for f in FIELD_ORDER}
    ).drop("at")


def validate_mapping(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """Mapping plus `errors`: required fields must be mapped and every mapped column must exist."""
    names = headers.groupBy("file_id").agg(F.collect_set("column_name").alias("names"))

    def absent(field: str, label: str) -> Column:
        name = F.col(f"{field}_col")
        return F.when(~F.array_contains("names", name), F.concat(F.lit(f"{label} column not found in data: "), name))

    checks = [
        F.when(F.col("datetime_col").isNull(), "No date/time column is mapped").otherwise(absent("datetime", "Datetime")),
        F.when(F.col("import_kwh_col").isNull(), "No energy usage column is mapped").otherwise(
            absent("import_kwh", "Import")),
        absent("export_kwh", "Export"),
        absent("mprn", "MPRN"),
        absent("cost", "Cost"),
    ]
    return mapping.join(names, "file_id").withColumn(
        "errors", F.filter(F.array(*checks), lambda e: e.isNotNull())
    ).drop("names")


def mapping_issues(validated: DataFrame) -> DataFrame:
    """One error row per mapping problem."""
    return validated.select("file_id", F.explode("errors").alias("message")).select(
        "file_id", F.lit("mapping").alias("category"), F.lit("error").alias("severity"), "message",
        F.lit(0).cast("bigint").alias("affected_rows"), F.lit(False).alias("auto_fixed"),
    )

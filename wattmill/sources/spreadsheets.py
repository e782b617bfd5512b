"""Delimited client files with unknown headers, as rows of cells plus a header table.

`sheet_rows(file_id, row_idx, cells)` keeps each line as one array, so renaming columns later is an array
lookup and never a pivot.  `sheet_headers(file_id, col_idx, column_name)` has one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.sources.records import join_quoted, opens_quote

# Cell texts that mean "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Parameters of the header search and of the sniffer, as the data model has them.
HEADER_SCAN_ROWS, UNNAMED_SHARE, UNNAMED_FIRST_ROW_SHARE = 10, 0.3, 0.5
SNIFF_BYTES = 2048
SNIFF_MARKS = ["MPRN", "Read Type", "Read Value"]


# Parts of a file's rows that tables of one row per file are joined to, so that no task gets a whole file.
FILE_PARTS = 64


def join_per_file(rows: DataFrame, per_file: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of a table of one row per file; the rows of a file are dealt to `FILE_PARTS` keys."""
    part = F.pmod(F.xxhash64("row_idx"), F.lit(FILE_PARTS)).cast("int")
    copied = per_file.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FILE_PARTS - 1))))
    return rows.withColumn("_part", part).join(copied, ["file_id", "_part"], how).drop("_part")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, row_idx, line) of every record of every .csv file, decoded as UTF-8 or, when any line of the
    file is not valid UTF-8, as Latin-1.  Files are split across tasks; line breaks inside quotes do not end a record.

    `row_idx` is the byte offset of the line's split plus its position in the task that reads the split.  It rises
    through the file and needs no sort: a split of n bytes holds at most n lines, and only a file's last split shares
    its task with splits before it, which can but raise its positions.
    """
    raw = (
        spark.read.option("pathGlobFilter", "*.[cC][sS][vV]")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file_id"),
            F.col("_metadata.file_block_start").alias("block"),
            (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
            .alias("row_idx"),
            F.col("value").alias("line"),
        )
    )
    # Only the verdicts per file come from a second look at the lines, and they are joined by file.
    files = raw.groupBy("file_id").agg(
        F.bool_and(F.expr("is_valid_utf8(line)")).alias("utf8"), F.bool_or(opens_quote(F.col("line"))).alias("breaks"))
    text = F.when(F.col("utf8"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    decoded = join_per_file(raw, files).select("file_id", "block", "row_idx", text.alias("line"), "breaks")
    # Without a line that leaves a quote open, every line is a record.
    plain = decoded.filter(~F.col("breaks")).select("file_id", "row_idx", "line")
    return plain.unionByName(join_quoted(decoded.filter("breaks").drop("breaks")))


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, kind): meter interval files by the marks in their head, other CSV, else unsupported.

    Only the first split of a file is looked at and only its head is kept.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.substring("value", 1, SNIFF_BYTES).alias("line"),
    ).filter(F.col("block") == 0)
    # The head is at most SNIFF_BYTES lines long, and that many short rows per file; the limit comes before the shuffle.
    from_top = Window.partitionBy("file_id").orderBy("seq")
    near = lines.withColumn("line_no", F.row_number().over(from_top)).filter(F.col("line_no") <= SNIFF_BYTES)
    head = near.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
        .alias("head")
    ).withColumn("head", F.substring("head", 1, SNIFF_BYTES))
    extension = F.lower(F.regexp_extract("file_id", r"\.([^./]+)$", 1))
    is_meter = F.lit(True)
    for mark in SNIFF_MARKS:
        is_meter = is_meter & F.col("head").contains(mark)
    return head.select(
        "file_id", F.when(is_meter, "meter").when(extension == "csv", "sheet").otherwise("unsupported").alias("kind")
    )


def blank_to_null(value: Column) -> Column:
    return F.when(~F.trim(value).isin(MISSING), value)


# A comma and the cell after it, bare or quoted; possessive, so a long cell costs no stack.
CELL = r',(?:"((?:[^"\\]++|\\.|"")*+)"[^,]*+|([^,]*+))'


def split_cells(lines: DataFrame) -> DataFrame:
    """Each line as an array of its own cells, however many, quotes respected; lines with no text are skipped."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit("(?s)" + CELL), F.lit(0))

    def cell(found: Column) -> Column:
        quoted = F.regexp_extract(found, "(?s)" + CELL, 1)
        plain = F.regexp_replace(quoted, r'["\\](["\\])', "$1")  # doubled or escaped
        return blank_to_null(F.when(F.startswith(found, F.lit(',"')), plain).otherwise(F.substr(found, F.lit(2))))

    return lines.filter(F.trim("line") != "").select("file_id", "row_idx", F.transform(raw, cell).alias("cells"))


def sheets_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First line of each file becomes its header; columns without a name are called `Unnamed: i`."""
    rows = split_cells(lines)
    tops = rows.groupBy("file_id").agg(F.min("row_idx").alias("top"))
    marked = join_per_file(rows, tops)
    width = (
        rows.select("file_id", F.array_max(
            F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(F.lit(0)))
        ).alias("n"))
        .groupBy("file_id")
        .agg(F.max("n").alias("width"))
    )
    headers = (
        marked.filter("row_idx = top")
        .join(width, "file_id")
        .filter("width > 0")
        .select("file_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("width") - 1),
                                                    lambda i: F.get("cells", i))).alias("col_idx", "name"))
        .select(
            "file_id", "col_idx",
            F.coalesce("name", F.concat(F.lit("Unnamed: "), F.col("col_idx").cast("string"))).alias("column_name"),
        )
    )
    return marked.filter("row_idx > top").drop("top"), headers


def read_sheets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read a folder of CSV files and recover headers hidden below logo or title rows."""
    return recover_headers(*sheets_from_lines(read_lines(spark, path)))


def recover_headers(rows: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where too many headers are unnamed, the fullest of the first ten rows becomes the header and the rows
    above it go.  The first row is only taken when more than half of the headers are unnamed.
    """
    named = headers.groupBy("file_id").agg(
        F.count("*").alias("columns"),
        F.count_if(F.col("column_name").startswith("Unnamed")).alias("unnamed"),
    )
    counts = rows.groupBy("file_id").agg(F.count("*").alias("n_rows"))
    suspects = (
        named.filter(F.col("unnamed") > F.col("columns") * UNNAMED_SHARE)
        .join(counts.filter("n_rows >= 2").drop("n_rows"), "file_id")
    )
    # Blank lines are gone already, so positions count rows and not lines; the limit is applied before the shuffle.
    from_top = Window.partitionBy("file_id").orderBy("row_idx")
    scanned = (
        join_per_file(rows, suspects)
        .withColumn("row_no", F.row_number().over(from_top))
        .filter(F.col("row_no") <= HEADER_SCAN_ROWS)
        .withColumn("position", F.col("row_no") - 1)
    )
    filled = F.size(F.filter("cells", lambda c: c.isNotNull() & (F.trim(c) != "")))
    best = (
        scanned.withColumn("score", F.size(F.filter("cells", lambda c: c.isNotNull())) + filled)
        .filter("score > 0")
        .groupBy("file_id", "columns", "unnamed")
        .agg(F.max_by(F.struct("row_idx", "position", "cells"), F.struct("score", (-F.col("position")).alias("p")))
             .alias("b"))
        .filter((F.col("b.position") > 0) | (F.col("unnamed") > F.col("columns") * UNNAMED_FIRST_ROW_SHARE))
        .select("file_id", F.col("b.row_idx").alias("header_row"), F.col("b.cells").alias("header_cells"))
    )
    found = headers.join(best, "file_id", "left").select(
        "file_id", "col_idx",
        F.when(
            F.col("header_row").isNotNull(), F.coalesce(F.trim(F.get("header_cells", F.col("col_idx"))), F.lit("nan"))
        ).otherwise(F.col("column_name")).alias("column_name"),
    )
    kept = join_per_file(rows, best.drop("header_cells"), "left").filter(
        F.col("header_row").isNull() | (F.col("row_idx") > F.col("header_row"))
    )
    return kept.drop("header_row"), found

import os
import tempfile

from frames import rows
from pyspark.sql import functions as F

from wattmill.sources import meter_files, spreadsheets
from wattmill.streaming import intake

METER = "MPRN, Read Value ,Read Type,Read Date and End Time\n"


def _folder(files):
    path = tempfile.mkdtemp(prefix="run-")
    for name, content in files.items():
        with open(os.path.join(path, name), "wb") as out:
            out.write(content)
    return path


def test_sheet_files(spark):
    folder = _folder({
        "plain.csv": "Date,Usage (kWh)\n01/02/2025,1.5\n02/02/2025,\"1,200\"\n".encode(),
        "latin.csv": "Date,Café\n01/02/2025,é\n".encode("latin-1"),
        "logo.csv": b"Report 2025,,\n,,\nDate,Usage,Cost\n01/02/2025,3,4\n",
    })
    sheet_rows, headers = spreadsheets.read_sheets(spark, folder)
    name = F.regexp_extract("file_id", r"([a-z]+)\.csv$", 1)
    names = rows(headers.select(name.alias("f"), "col_idx", "column_name"), "f", "col_idx")
    assert names == [("latin", 0, "Date"), ("latin", 1, "Café"), ("logo", 0, "Date"), ("logo", 1, "Usage"), ("logo", 2, "Cost"),
                     ("plain", 0, "Date"), ("plain", 1, "Usage (kWh)")]
    cells = rows(sheet_rows.select(name.alias("f"), "row_idx", F.get("cells", F.lit(1)).alias("c")), "f", "row_idx")
    assert [(f, c) for f, _, c in cells] == [("latin", "é"), ("logo", "3"), ("plain", "1.5"), ("plain", "1,200")]


def test_meter_files_and_kinds(spark):
    folder = _folder({"m.csv": (METER + "10000000001,0.4,Active Import Interval (kWh),01-03-2025 00:30\n").encode(),
                      "s.csv": b"a,b\n1,2\n"})
    kinds = {r["file_id"].split("/")[-1]: r["kind"] for r in spreadsheets.file_kinds(spark, folder).collect()}
    assert kinds == {"m.csv": "meter", "s.csv": "sheet"}
    only = _folder({"m.csv": (METER + "10000000001,0.4,Active Import Interval (kWh),01-03-2025 00:30\n").encode()})
    assert meter_files.parse_meter_files(spark, only).select("mprn", "import_kwh").collect()[0] == ("10000000001", 0.4)


def test_streamed_totals_equal_the_batch(spark):
    lines = "".join(f"10000000001,0.5,Active Import Interval (kWh),0{d}-03-2025 {h:02d}:30\n" for d in (1, 2) for h in range(24))
    folder = _folder({"m.csv": (METER.replace(" Read Value ", "Read Value") + lines).encode()})
    query = intake.start(intake.running_daily_totals(intake.stream_reads(spark, folder)), "totals", tempfile.mkdtemp(prefix="run-"),
                         "memory", mode="complete")
    query.awaitTermination(60)
    got = rows(spark.sql("SELECT cast(date AS string), import_kwh FROM totals"), "date")
    assert got == [("2025-03-01", 12.0), ("2025-03-02", 12.0)]


def test_streamed_uploads_are_taken_once(spark):
    folder = _folder({"a.pdf": b"same", "b.pdf": b"same", "c.pdf": b"other"})
    query = intake.start(intake.new_uploads(intake.stream_uploads(spark, folder)), "uploads", tempfile.mkdtemp(prefix="run-"), "memory", mode="append")
    query.awaitTermination(60)
    assert spark.sql("SELECT count(*) FROM uploads").collect()[0][0] == 2


def test_wide_sheets_and_blank_lines_above_the_header(spark):
    wide = ",".join(f"c{i}" for i in range(200)) + "\n" + ",".join(str(i) for i in range(200)) + "\n"
    quoted = 'Name,Note\n"a, ""b""","x\\"y"\n"' + "long " * 20000 + '",z\n'
    late = "Report,,\n" + "\n" * 12 + ",,\n\n" * 4 + "Date,Usage,Usage\n01/02/2025,3,4\n"
    folder = _folder({"wide.csv": wide.encode(), "quoted.csv": quoted.encode(), "late.csv": late.encode()})
    sheet_rows, headers = spreadsheets.read_sheets(spark, folder)
    name = F.regexp_extract("file_id", r"([a-z]+)\.csv$", 1)
    names = {}
    for f, _, c in rows(headers.select(name.alias("f"), "col_idx", "column_name"), "f", "col_idx"):
        names.setdefault(f, []).append(c)
    assert names == {"wide": [f"c{i}" for i in range(200)], "quoted": ["Name", "Note"], "late": ["Date", "Usage", "Usage"]}
    cells = {}
    for f, _, c in rows(sheet_rows.select(name.alias("f"), "row_idx", "cells"), "f", "row_idx"):
        cells.setdefault(f, []).append(list(c))
    assert cells["wide"] == [[str(i) for i in range(200)]] and cells["late"] == [["01/02/2025", "3", "4"]]
    assert cells["quoted"] == [['a, "b"', 'x"y'], ["long " * 20000, "z"]]


def test_edited_mapping_takes_the_first_of_equal_names(spark):
    from wattmill.operators.mapping import FIELD_ORDER, locate_columns

    headers = spark.createDataFrame([("f", 0, "Date"), ("f", 1, "Usage"), ("f", 2, "Usage")],
                                    "file_id string, col_idx int, column_name string")
    mapping = spark.createDataFrame([("f", "Date", "Usage")], "file_id string, datetime_col string, import_kwh_col string")
    for field in FIELD_ORDER:
        if f"{field}_col" not in mapping.columns:
            mapping = mapping.withColumn(f"{field}_col", F.lit(None).cast("string"))
    got = locate_columns(mapping, headers).collect()[0]
    assert (got["datetime_idx"], got["import_kwh_idx"], got["export_kwh_idx"]) == (0, 1, None)


def test_overlapping_meter_files_are_not_added_up(spark):
    from wattmill.operators.readings import file_reads, file_reports

    line = "{},{},Active Import Interval (kWh),0{}-03-2025 00:30\n"
    folder = _folder({
        "a.csv": (METER + line.format("10000000001", 1, 1) + line.format("10000000002", 5, 1)).encode(),
        "b.csv": (METER + "".join(line.format("10000000001", 2, d) for d in (1, 2, 3))).encode(),
    })
    raw = meter_files.read_meter_files(spark, folder)
    got = rows(meter_files.parse_meter_files(spark, folder).select(
        "mprn", F.col("date").cast("string"), "import_kwh", "repeats"), "mprn", "date")
    assert got == [("10000000001", "2025-03-01", 1.0, 1), ("10000000001", "2025-03-02", 2.0, 0),
                   ("10000000001", "2025-03-03", 2.0, 0), ("10000000002", "2025-03-01", 5.0, 0)]
    reports = file_reports(file_reads(raw)).select(F.substring_index("file_id", "/", -1).alias("f"), "total_rows_clean")
    assert rows(reports, "f") == [("a.csv", 2), ("b.csv", 3)]


def test_filters_pass_the_extraction_steps(spark):
    from wattmill.operators.extract import detect_provider, detect_supplier

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for step in (detect_provider, detect_supplier):
        plan = step(docs).filter("doc_id = 7 AND lang = 'en'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(doc_id,7)" in plan and "EqualTo(lang,en)" in plan

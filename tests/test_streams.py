"""Streams of meter files beside the batch over the same files, replays, and the ledger of uploads."""

import os
import random
import tempfile

from frames import rows
from pyspark.sql import functions as F

from wattmill.operators.readings import file_reads, one_file_per_instant
from wattmill.sources import ledger, meter_files
from wattmill.streaming import meters

HEAD = "MPRN,Read Value,Read Type,Read Date and End Time\n"
IMPORT, EXPORT = "Active Import Interval ({})", "Active Export Interval ({})"


def _put(folder, name, lines):
    path = os.path.join(folder, f".{name}")
    with open(path, "w") as out:
        out.write(HEAD + "".join(",".join(map(str, line)) + "\n" for line in lines))
    os.rename(path, os.path.join(folder, name))


def _reads(mprn, day, unit="kWh", hours=range(24), exports=(), exports_only=(), seed=0):
    random.seed(f"{mprn}{day}{seed}")
    out = []
    for h in hours:
        for m in ("00", "30"):
            if (h, m) not in exports_only:
                out.append((mprn, round(random.random() * 3, 3), IMPORT.format(unit), f"{day} {h:02d}:{m}"))
            if h in exports or (h, m) in exports_only:
                out.append((mprn, round(random.random(), 3), EXPORT.format(unit), f"{day} {h:02d}:{m}"))
    return out


# File by file in the order of arrival: kW, exports alone, both clock changes, overlaps with earlier and later names.
FILES = [
    ("m1.csv", _reads("10000000001", "30-03-2025", exports=(12, 13))),
    ("k2.csv", _reads("10000000002", "30-03-2025", unit="kW", exports_only=[(3, "00"), (5, "30")])),
    ("a3.csv", _reads("10000000001", "30-03-2025", hours=range(6, 12), seed=1)),
    ("z4.csv", _reads("10000000001", "30-03-2025", hours=range(20, 24), seed=2) + _reads("10000000003", "26-10-2025")),
    ("n5.csv", _reads("10000000002", "31-03-2025", unit="kW") + _reads("10000000002", "01-04-2025", unit="kW")),
    ("late.csv", _reads("10000000003", "01-01-2024") + _reads("10000000002", "29-03-2025", exports=(9,))),
]


def _batch(spark, folder):
    return one_file_per_instant(file_reads(meter_files.read_meter_files(spark, folder)))


def _sums(df, *by):
    return rows(df.groupBy(*by).agg(F.round(F.sum("import_kwh"), 6), F.round(F.sum("export_kwh"), 6)), *by)


READING = ("file_id", "mprn", "datetime", "datetime_utc", "import_kwh", "export_kwh", "repeats")


def test_stream_equals_batch_after_every_file(spark):
    folder, out, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for name, lines in FILES:
        _put(folder, name, lines)
        tables = meters.MeterTables(spark, out, buckets=2)
        meters.start(meters.stream_raw_reads(spark, folder), tables, state).awaitTermination(120)
    batch = _batch(spark, folder)
    assert rows(tables.current("readings").select(*READING), *READING[1:3]) == rows(batch.select(*READING), *READING[1:3])
    day, month = F.to_date("datetime").alias("date"), F.date_format("datetime", "yyyy-MM").alias("month")
    assert rows(tables.current("days").select("mprn", "date", F.round("import_kwh", 6), F.round("export_kwh", 6)),
                "mprn", "date") == _sums(batch.select("*", day), "mprn", "date")
    assert rows(tables.current("months").select("mprn", "month", F.round("import_kwh", 6), F.round("export_kwh", 6)),
                "mprn", "month") == _sums(batch.select("*", month), "mprn", "month")
    kw = tables.current("readings").filter("file_id LIKE '%/k2.csv'")
    assert kw.count() == 44 and kw.filter("import_kwh > 1.5").count() == 0  # 48, two of exports alone, two in one hour twice


def test_a_replayed_batch_changes_nothing(spark):
    folder, out = (tempfile.mkdtemp(prefix="run-") for _ in range(2))
    for name, lines in FILES[:3]:
        _put(folder, name, lines)
    tables = meters.MeterTables(spark, out)
    paths = [meter_files.read_meter_files(spark, os.path.join(folder, name)) for name, _ in FILES[:3]]
    tables.add(paths[0], 0)
    tables.add(paths[1].unionByName(paths[2]), 1)
    before = rows(tables.current("readings"), "mprn", "datetime")
    assert len(before) >= 90
    tables.add(paths[1].unionByName(paths[2]), 1)
    tables.add(paths[0], 0)
    assert rows(tables.current("readings"), "mprn", "datetime") == before
    # A micro-batch that ended before its manifest row: its files are not read, and its replay writes them anew.
    tables.tables.write(tables._parted(_batch(spark, folder)).select(*tables.schemas["readings"].names), "readings", 2)
    assert rows(tables.current("readings"), "mprn", "datetime") == before
    tables.add(paths[0], 2)
    again = tables.current("readings")
    assert again.count() == len(before) and again.agg(F.sum("repeats")).first()[0] > sum(r[6] for r in before)


def test_only_new_contents_are_taken(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    schema = "file_id string, arrival int, content binary"

    def run(number, *files):
        new = ledger.take_new(spark.createDataFrame([(n, a, c.encode()) for n, a, c in files], schema), folder, number)
        return rows(new.select("file_id", "copies"), "file_id")

    first = ("a", 1, "same"), ("b", 0, "same"), ("c", 2, "other")
    assert run(1, *first) == [("b", 2), ("c", 1)]
    assert run(2, *first, ("d", 3, "new"), ("e", 4, "new"), ("f", 5, "more")) == [("d", 2), ("f", 1)]
    assert run(2, *first, ("d", 3, "new")) == [("d", 2), ("f", 1)]  # run 2 once more: what it took
    assert run(3, *first, ("d", 9, "new")) == []
    assert run(4, ("x", 1, "more"), ("y", 1, "last")) == [("y", 1)]

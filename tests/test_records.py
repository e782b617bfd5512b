"""Quoted line breaks against a reader that goes through each file letter by letter."""

import csv
import io
import os
import random
import tempfile

import pytest
from frames import rows
from pyspark.sql import functions as F

from wattmill.sources import spreadsheets


@pytest.fixture
def small_splits(spark):
    """Splits of 40 bytes, so that many records cross one."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def folder_of(files):
    path = tempfile.mkdtemp(prefix="run-")
    for name, content in files.items():
        with open(os.path.join(path, name), "w", newline="") as out:
            out.write(content)
    return path


def records(text):
    """Records of a text, letter by letter; a quote opens only at the start of a cell."""
    out, at, start, inside, fresh, opened = [], 0, 0, False, True, 0
    while at < len(text):
        c = text[at]
        if inside:
            if c == "\\":
                at += 1 if text[at + 1:at + 2] != "\n" else 0
            elif c == '"' and text[at + 1:at + 2] == '"':
                at += 1
            elif c == '"':
                inside = False
        elif c == "\n":
            out.append(text[start:at])
            start, fresh = at + 1, True
            at += 1
            continue
        elif c == '"' and fresh:
            inside, opened = True, start
        fresh = not inside and c == ","
        at += 1
    if inside:
        return out + text[opened:].split("\n")[:None if text[-1] != "\n" else -1]
    return out + ([text[start:]] if start < len(text) else [])


def read(spark, folder):
    name = F.substring_index("file_id", "/", -1)
    out = {}
    for f, _, line in rows(spreadsheets.read_lines(spark, folder).select(name.alias("f"), "row_idx", "line"), "f", "row_idx"):
        out.setdefault(f, []).append(line)
    return out


def test_made_files(spark, small_splits):
    random.seed(11)
    bits = ["a", ",", '"', "\n", '""', "word ", ',"', '",', "\\", "é", "\n\n", "12"]
    files = {f"f{i}.csv": "".join(random.choices(bits, k=random.randint(1, 150))) for i in range(25)}
    got = read(spark, folder_of(files))
    for name, text in files.items():
        assert got.get(name, []) == records(text), repr(text)


def test_written_by_the_csv_module(spark, small_splits):
    random.seed(12)
    want, files = {}, {}
    for i in range(6):
        table = [["id", "note"]] + [[str(r), "".join(random.choices(["x", "\n", '"', ",", " long text "], k=random.randint(1, 30)))]
                                    for r in range(12)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if i % 2 else csv.QUOTE_MINIMAL).writerows(table)
        files[f"f{i}.csv"], want[f"f{i}.csv"] = out.getvalue(), table
    cells, headers = spreadsheets.read_sheets(spark, folder_of(files))
    name = F.substring_index("file_id", "/", -1)
    got = {}
    for f, _, c in rows(cells.select(name.alias("f"), "row_idx", "cells"), "f", "row_idx"):
        got.setdefault(f, []).append(list(c))
    for f, table in want.items():
        assert got[f] == [[x if x.strip() else None for x in row] for row in table[1:]]
    assert headers.count() == 12


def test_a_quote_never_closed_opens_nothing(spark, small_splits):
    text = 'a,b\n1,"two\nlines"\n2,"open\n' + "".join(f"{i},plain\n" for i in range(40))
    assert read(spark, folder_of({"f.csv": text}))["f.csv"] == [
        "a,b", '1,"two\nlines"', '2,"open', *[f"{i},plain" for i in range(40)]]

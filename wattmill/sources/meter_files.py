"""Meter interval files and other inputs with a fixed layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.operators.readings import normalise_reads

RAW_READS = "file_id string, row_idx bigint, mprn string, read_value string, read_type string, read_time string"
# Column names of a meter file and ours.
METER_COLUMNS = {
    "MPRN": "mprn", "Read Value": "read_value", "Read Type": "read_type", "Read Date and End Time": "read_time",
}


def read_meter_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw reads of a folder of meter CSV files; header names may carry blanks.

    All columns are text.  The reader splits large files, and `row_idx` only needs to rise within a file.
    """
    raw = spark.read.option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("file_id"), F.monotonically_increasing_id().alias("row_idx")
    )
    names = {c: METER_COLUMNS[c.strip()] for c in raw.columns if c.strip() in METER_COLUMNS}
    return raw.select("file_id", "row_idx", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def parse_meter_files(spark: SparkSession, path: str) -> DataFrame:
    """Clean interval readings of all meters in a folder."""
    return normalise_reads(read_meter_files(spark, path))


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fixtures, critical fields) from a ground-truth JSON document."""
    schema = (
        "_meta struct<scoring_spec:struct<critical_fields:array<string>,critical_weight:double,"
        "non_critical_weight:double>>, fixtures array<struct<filename:string,provider:string,bill_type:string,"
        "location:string,input_type:string,expected:map<string,string>,not_applicable:array<string>,notes:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    fixtures = doc.select(F.explode("fixtures").alias("f")).select("f.*").withColumn(
        "not_applicable", F.coalesce("not_applicable", F.array().cast("array<string>"))
    )
    return fixtures, doc.select(F.explode("_meta.scoring_spec.critical_fields").alias("field_name"))


def first_uploads(files: DataFrame) -> DataFrame:
    """First arrival of every distinct content: files(file_id, arrival, content BINARY).

    Only hash, id and arrival are shuffled, and copies are merged before the shuffle.
    """
    hashed = files.select("file_id", "arrival", F.md5("content").alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(
        F.min(F.struct("arrival", "file_id")).alias("first"), F.count("*").alias("copies")
    )
    return firsts.select("content_hash", "first.file_id", "first.arrival", "copies")

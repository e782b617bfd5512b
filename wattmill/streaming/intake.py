"""Incremental intake: new files once by content, and running totals with late reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattmill.functions.dates import parse_read_time
from wattmill.functions.numbers import to_number
from wattmill.sources.meter_files import METER_COLUMNS

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
READS_SCHEMA = ", ".join(f"`{c}` string" for c in METER_COLUMNS)


def stream_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as they arrive, with the hash of their content."""
    files = spark.readStream.format("binaryFile").schema(FILES_SCHEMA).load(path)
    return files.select(
        F.col("path").alias("file_id"), F.col("modificationTime").alias("arrival"),
        F.md5("content").alias("content_hash"), "length",
    )


def new_uploads(uploads: DataFrame, remember: str | None = None) -> DataFrame:
    """Each content once.  Hashes are kept for ever, or for `remember` (for example '30 days') to bound the state."""
    if remember is None:
        return uploads.dropDuplicates(["content_hash"])
    return uploads.withWatermark("arrival", remember).dropDuplicatesWithinWatermark(["content_hash"])


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """Meter files of a folder as typed reads (mprn, datetime, kind, kwh)."""
    raw = spark.readStream.schema(READS_SCHEMA).option("header", True).csv(path)
    return raw.select(
        F.trim("MPRN").alias("mprn"),
        parse_read_time(F.col("Read Date and End Time")).cast("timestamp").alias("datetime"),
        F.lower("Read Type").alias("kind"),
        to_number(F.col("Read Value")).alias("kwh"),
    ).filter(F.col("datetime").isNotNull())


def running_daily_totals(reads: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Import and export per meter and date; reads later than `lateness` are left out and closed dates leave the state."""
    imported, exported = F.col("kind").contains("import"), F.col("kind").contains("export")
    return (
        reads.withWatermark("datetime", lateness)
        .groupBy("mprn", F.window("datetime", "1 day").alias("day"))
        .agg(
            F.coalesce(F.sum(F.when(imported, F.col("kwh"))), F.lit(0.0)).alias("import_kwh"),
            F.coalesce(F.sum(F.when(exported, F.col("kwh"))), F.lit(0.0)).alias("export_kwh"),
        )
        .select("mprn", F.col("day.start").cast("date").alias("date"), "import_kwh", "export_kwh")
    )


def start(df: DataFrame, name: str, checkpoint: str, sink: str, mode: str = "update", **options: str) -> StreamingQuery:
    """Start a query into the named sink; the checkpoint belongs in storage that all executors share."""
    writer = df.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint)
    return writer.options(**options).trigger(availableNow=True).start()

"""Meter files as a stream into readings, daily and monthly totals that equal a batch over all files.

A file comes whole in one micro-batch, so the rules inside a file (its unit by its first read, import and export joined
by instant, instants with exports only left out, clock changes) are those of `operators.readings` on the micro-batch. What
lasts between micro-batches is the reading of each meter and instant, of the first file by name, in parts by month and
meter. A micro-batch rewrites the parts it touches, then their days and months, and ends with one row in the manifest: a
micro-batch replayed after that does nothing, one replayed before writes the same files again. Reads may be any late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattmill.operators.readings import file_reads, one_file_per_instant
from wattmill.sources.meter_files import METER_COLUMNS, RAW_READS
from wattmill.sources.versions import VersionedTables

PARTS = {"month": "string", "bucket": "int"}
BUCKETS = 16  # parts of a month, by meter; more for more meters


def stream_raw_reads(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Raw reads of the meter files of a folder as they arrive, as `read_meter_files` gives them but with `block`, the
    split of a read, for its place: places in a split are numbered in the micro-batch (`numbered`)."""
    reads = spark.readStream.schema(", ".join(f"`{c}` string" for c in METER_COLUMNS)).option("header", True)
    return reads.options(**options).csv(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        *[F.col(f"`{c}`").alias(n) for c, n in METER_COLUMNS.items()])


def numbered(raw: DataFrame) -> DataFrame:
    """Raw reads of a micro-batch with `row_idx`, which rises within a file."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.withColumn("row_idx", F.col("block") + place).drop("block")


class MeterTables:
    """Readings, days and months below a folder; `add` takes the raw reads of a micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.tables = VersionedTables(spark, folder, PARTS)
        empty = self._parted(one_file_per_instant(file_reads(spark.createDataFrame([], RAW_READS))))
        self.schemas = {"readings": empty.schema, "days": self._days(empty).schema,
                        "months": self._months(self._days(empty)).schema}

    def _parted(self, reads: DataFrame) -> DataFrame:
        return reads.withColumns({"month": F.date_format("datetime", "yyyy-MM"),
                                  "bucket": F.pmod(F.xxhash64("mprn"), F.lit(self.buckets)).cast("int")})

    @staticmethod
    def _days(readings: DataFrame) -> DataFrame:
        return readings.groupBy("mprn", F.to_date("datetime").alias("date"), *PARTS).agg(
            F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"), F.count("*").alias("reads"))

    @staticmethod
    def _months(days: DataFrame) -> DataFrame:
        """A part holds whole months of its meters, so its days are all the days of its months."""
        return days.groupBy("mprn", *PARTS).agg(
            F.sum("import_kwh").alias("import_kwh"), F.sum("export_kwh").alias("export_kwh"),
            F.count("*").alias("days"), F.sum("reads").alias("reads"))

    def add(self, raw: DataFrame, run: int) -> None:
        if run <= self.tables.last_run():
            return
        names = self.schemas["readings"].names
        new = self.tables.write(self._parted(one_file_per_instant(file_reads(raw))).select(*names), "incoming", run)
        old = self.tables.current("readings", self.schemas["readings"], before=run, only=new)
        # Of each instant the first file by name; the others are counted.
        merged = old.unionByName(new).groupBy("mprn", "datetime", "datetime_utc", *PARTS).agg(
            F.min(F.struct("file_id", "import_kwh", "export_kwh")).alias("r"),
            (F.sum(F.col("repeats") + 1) - 1).alias("repeats")).select(
            "r.file_id", "mprn", "datetime", "datetime_utc", "r.import_kwh", "r.export_kwh", "repeats", *PARTS)
        readings = self.tables.write(merged.select(*names), "readings", run)
        days = self.tables.write(self._days(readings), "days", run)
        self.tables.write(self._months(days), "months", run)
        self.tables.commit("readings", run)

    def current(self, table: str) -> DataFrame:
        """`readings`, `days` or `months` as of the last micro-batch that ended."""
        return self.tables.current(table, self.schemas[table])


def start(raw: DataFrame, tables: MeterTables, checkpoint: str) -> StreamingQuery:
    """Feed a stream of raw reads into the tables; the checkpoint belongs in storage that all executors share."""
    def add(batch: DataFrame, run: int) -> None:
        tables.add(numbered(batch), run)

    return (raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

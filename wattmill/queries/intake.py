"""Files that arrive over time: streams of meter files, the ledger of uploads, and CSV records with line breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.functions import calendar as cal
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.sources import raw_reads
from wattmill.queries.views import READINGS_SQL, table
from wattmill.session import shared_path
from wattmill.sources import ledger, spreadsheets
from wattmill.sources.meter_files import METER_COLUMNS
from wattmill.streaming import meters

FILES_A_DIGIT, MICRO_BATCHES = 4, 5


def meter_folder(spark, sf) -> str:
    """All raw reads as meter files: several meters to a file, kW and kWh apart, as a file has one unit."""
    raw = raw_reads(spark, sf).withColumn("digit", F.substring(F.trim("mprn"), 11, 1))
    part = F.pmod(F.xxhash64(F.trim("mprn")), F.lit(FILES_A_DIGIT))
    folder = shared_path(spark, "meter-files")
    (raw.select("digit", part.alias("part"), "row_idx", *[F.col(n).alias(c) for c, n in METER_COLUMNS.items()])
     .repartition("digit", "part").sortWithinPartitions("digit", "part", "row_idx").drop("row_idx")
     .write.partitionBy("digit", "part").option("header", True).csv(folder))
    return folder


def streamed(spark, sf) -> meters.MeterTables:
    """The tables after a stream over all meter files, in several micro-batches."""
    tables = meters.MeterTables(spark, shared_path(spark, "meter-tables"), buckets=4)
    raw = meters.stream_raw_reads(spark, meter_folder(spark, sf), recursiveFileLookup="true",
                                  maxFilesPerTrigger=str(-(-10 * FILES_A_DIGIT // MICRO_BATCHES)))
    meters.start(raw, tables, shared_path(spark, "meter-stream")).awaitTermination()
    return tables


@query(
    "stream_readings",
    rounded_sql("SELECT mprn, datetime, import_kwh, export_kwh, tariff_period FROM readings", "import_kwh, export_kwh",
                READINGS_SQL),
)
def stream_readings(spark, sf):
    return streamed(spark, sf).current("readings").select(
        "mprn", "datetime", "import_kwh", "export_kwh", cal.tariff_period(F.hour("datetime")).alias("tariff_period"))


@query(
    "stream_months",
    rounded_sql("""SELECT mprn, strftime(datetime, '%Y-%m') AS month, sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh,
                     count(DISTINCT datetime::DATE) AS days, count(*) AS reads FROM readings GROUP BY ALL""",
                "import_kwh, export_kwh", READINGS_SQL),
)
def stream_months(spark, sf):
    return streamed(spark, sf).current("months").select("mprn", "month", "import_kwh", "export_kwh", "days", "reads")


@query(
    "ledger_second_run",
    """SELECT md5(text) AS content_hash, min(doc_id) AS file_id, count(*) AS copies FROM documents AS d
       WHERE NOT EXISTS (SELECT 1 FROM documents AS e WHERE e.lang = 'en' AND md5(e.text) = md5(d.text)) GROUP BY 1""",
)
def ledger_second_run(spark, sf):
    """English documents come first; the second run is given all documents and takes the contents not yet seen."""
    files = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), F.col("text").cast("binary").alias("content"),
        "lang")
    folder = shared_path(spark, "ledger")
    ledger.take_new(files.filter("lang = 'en'"), folder, 1)
    return ledger.take_new(files, folder, 2).select("content_hash", "file_id", "copies")


@query("quoted_records", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS content_hash FROM documents")
def quoted_records(spark, sf):
    """Documents through CSV files and back: texts with line breaks, commas and quotes are one cell each."""
    folder = shared_path(spark, "quoted")
    (table(spark, sf, "documents").select(F.col("doc_id").alias("Document"), F.col("text").alias("Text"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder))
    cells, _ = spreadsheets.read_sheets(spark, folder)
    return cells.select(F.get("cells", F.lit(0)).alias("doc_id"), F.md5(F.get("cells", F.lit(1)).cast("binary")).alias("content_hash"))

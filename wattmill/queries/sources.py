"""Raw reads, upload dedup and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.operators import readings as rd
from wattmill.operators import profiles, stats
from wattmill.queries.bills import BY, compared
from wattmill.queries.meter import METER_SQL, SUMMARY_SQL, with_code
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import BILLS_SQL, READINGS_SQL, readings, table
from wattmill.sources import exports
from wattmill.sources.meter_files import first_uploads


def raw_reads(spark, sf):
    """Readings written back as meter-file rows: a file per meter, some in kW, some with slash dates."""
    base = readings(spark, sf)
    digit = F.substring("mprn", 11, 1).cast("int")
    in_kw, slashes = digit == 3, digit == 4
    unit = F.when(in_kw, "(kW)").otherwise("(kWh)")
    scale = F.when(in_kw, 2.0).otherwise(1.0)
    stamp = F.when(slashes, F.date_format("datetime", "dd/MM/yyyy HH:mm")).otherwise(
        F.date_format("datetime", "dd-MM-yyyy HH:mm"))
    reads = F.array(
        F.struct(F.concat(F.lit("Active Import Interval "), unit).alias("read_type"),
                 F.format_string("%.6f", F.col("import_kwh") * scale).alias("read_value"), F.lit(0).alias("n")),
        F.struct(F.concat(F.lit("Active Export Interval "), unit).alias("read_type"),
                 F.format_string("%.6f", F.col("export_kwh") * scale).alias("read_value"), F.lit(1).alias("n")),
    )
    at = (F.unix_micros(F.col("datetime").cast("timestamp")) / 1000000).cast("bigint") * 2
    rows = base.select(F.concat(F.lit("file_"), F.col("mprn")).alias("file_id"), at.alias("at"), "mprn",
                       stamp.alias("read_time"), F.inline(reads))
    return rows.select("file_id", (F.col("at") + F.col("n")).alias("row_idx"), F.concat(F.lit(" "), F.col("mprn")).alias("mprn"),
                       "read_value", "read_type", "read_time")


def overlapping_reads(spark, sf):
    """The same files, and files with every fifth day of several meters once more, with other amounts."""
    raw = raw_reads(spark, sf)
    day = F.substring("read_time", 1, 2).cast("int")
    again = raw.filter(day % 5 == 0).withColumns({
        "file_id": F.concat(F.lit("late_"), F.substring(F.trim("mprn"), 11, 1)),
        "read_value": F.format_string("%.6f", F.col("read_value").cast("double") + 1),
    })
    return raw.unionByName(again)


@query(
    "hdf_overlap",
    rounded_sql(
        """SELECT mprn, datetime, import_kwh, export_kwh, 'file_' || mprn AS file_id,
             (extract(day FROM datetime) % 5 = 0)::INTEGER::BIGINT AS repeats FROM readings""",
        "import_kwh, export_kwh", READINGS_SQL),
)
def hdf_overlap(spark, sf):
    out = rd.normalise_reads(overlapping_reads(spark, sf))
    return out.select("mprn", "datetime", "import_kwh", "export_kwh", "file_id", "repeats")


@query(
    "hdf_normalise",
    rounded_sql("SELECT mprn, datetime, import_kwh, export_kwh, tariff_period FROM readings", "import_kwh, export_kwh", READINGS_SQL),
)
def hdf_normalise(spark, sf):
    out = rd.normalise_reads(raw_reads(spark, sf))
    return out.select("mprn", "datetime", "import_kwh", "export_kwh", "tariff_period")


@query(
    "hdf_file_report",
    f"""WITH {READINGS_SQL}, files AS (
          SELECT 'file_' || mprn AS file_id, datetime FROM readings
          UNION ALL SELECT 'late_' || substr(mprn, 11, 1), datetime FROM readings WHERE extract(day FROM datetime) % 5 = 0)
        SELECT file_id, count(*) AS total_rows_raw, count(*) AS total_rows_clean, 0::BIGINT AS rows_dropped,
          min(datetime) AS date_range_start, max(datetime) AS date_range_end, '30min' AS granularity,
          100.0::DOUBLE AS completeness_pct
        FROM files GROUP BY file_id""",
)
def hdf_file_report(spark, sf):
    return rd.file_reports(rd.file_reads(overlapping_reads(spark, sf)))


@query(
    "dedup_uploads",
    """SELECT md5(text) AS content_hash, min(doc_id) AS file_id, count(*) AS copies FROM documents GROUP BY 1""",
)
def dedup_uploads(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), F.col("text").cast("binary").alias("content"))
    return first_uploads(files).select("content_hash", "file_id", "copies")


@query(
    "export_monthly",
    rounded_sql("SELECT mprn, year_month, sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh FROM readings GROUP BY ALL",
                "import_kwh, export_kwh", READINGS_SQL),
)
def export_monthly(spark, sf):
    source = readings(spark, sf)
    return exports.meter_tables(source, stats.summary_stats(source))["monthly"]


_PRINTED = {None: "CAST({} AS VARCHAR)", 1: "printf('%.1f', round({}, 1))", 2: "printf('%.2f', round({}, 2))",
            "yyyy-MM-dd": "strftime({}, '%Y-%m-%d')", "yyyy-MM-dd HH:mm": "strftime({}, '%Y-%m-%d %H:%M')"}
_SUMMARY_VALUES = ", ".join(_PRINTED[style].format(column) for _, column, style in exports.SUMMARY_ROWS)
_SUMMARY_LABELS = ", ".join(f"'{label}'" for label, _, _ in exports.SUMMARY_ROWS)


@query(
    "export_summary",
    f"""WITH {METER_SQL}, st AS ({SUMMARY_SQL})
        SELECT mprn, unnest(range({len(exports.SUMMARY_ROWS)}))::INTEGER AS row_no, unnest([{_SUMMARY_LABELS}]) AS metric,
               unnest([{_SUMMARY_VALUES}]) AS value FROM st""",
)
def export_summary(spark, sf):
    return exports.summary_rows(stats.summary_stats(readings(spark, sf)))


@query(
    "export_flexible_daily",
    rounded_sql(
        """SELECT mprn, date, sum(import_kwh) AS import_kwh, sum(export_kwh) AS export_kwh FROM readings
           WHERE CAST(substr(mprn, 11, 1) AS INTEGER) % 3 <> 2 GROUP BY ALL""",
        "import_kwh, export_kwh", READINGS_SQL),
)
def export_flexible_daily(spark, sf):
    """Monthly series have no dates, so their meters have no daily table."""
    coded = with_code(readings(spark, sf))
    dated = coded.withColumn("date", F.when(F.col("granularity") != "monthly", F.col("date")))
    return exports.meter_tables_flexible(dated, stats.summary_stats_flexible(coded))["daily"]


@query(
    "gated_load_profile",
    rounded_sql(
        """SELECT mprn, hour::INTEGER AS hour, avg(import_kwh) FILTER (WHERE NOT is_weekend) * 2 AS weekday_kw,
           avg(import_kwh) FILTER (WHERE is_weekend) * 2 AS weekend_kw FROM readings
           WHERE CAST(substr(mprn, 11, 1) AS INTEGER) % 3 = 0 GROUP BY mprn, hour""",
        "weekday_kw, weekend_kw", READINGS_SQL),
)
def gated_load_profile(spark, sf):
    """Only interval series have a load profile."""
    return profiles.profiles_for(with_code(readings(spark, sf)))["load_profile"]


@query(
    "export_comparison_bills",
    f"""WITH {BILLS_SQL} SELECT bill_idx, filename AS sheet, f.field, f.value FROM rows,
        LATERAL (SELECT unnest(['Status', 'Bill Date']) AS field, unnest([status, nullif(bill_date, '')]) AS value) f""",
)
def export_comparison_bills(spark, sf):
    from wattmill.queries.views import bills

    sheets = exports.comparison_tables(compared(spark, sf), bills(spark, sf), BY)["bills"]
    return sheets.filter(F.col("field").isin("Status", "Bill Date")).drop("row_no")

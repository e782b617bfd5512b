"""Report tables and their writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.operators import bills as bl
from wattmill.operators import profiles

# Rows of the meter summary, in print order (label, column, decimals).
SUMMARY_ROWS = [
    ("MPRN", "mprn", None), ("Start Date", "start_date", "yyyy-MM-dd"), ("End Date", "end_date", "yyyy-MM-dd"),
    ("Days of Data", "date_range_days", None), ("Total Import (kWh)", "total_import_kwh", 1),
    ("Total Export (kWh)", "total_export_kwh", 1), ("Net Import (kWh)", "net_import_kwh", 1),
    ("Daily Average (kWh)", "avg_daily_import_kwh", 1), ("Baseload (kW)", "baseload_kw", 2),
    ("Peak Demand (kW)", "peak_kw", 1), ("Peak Time", "peak_time", "yyyy-MM-dd HH:mm"),
    ("Weekday Avg (kWh/day)", "weekday_avg_kwh", 1), ("Weekend Avg (kWh/day)", "weekend_avg_kwh", 1),
]
# Labels that do not follow from the field name.
UNIT_SUFFIXES = {
    "day_units_kwh": "Day Units (kWh)", "night_units_kwh": "Night Units (kWh)", "peak_units_kwh": "Peak Units (kWh)",
    "total_units_kwh": "Total Units (kWh)", "mprn": "MPRN", "dg_code": "DG Code", "mcc_code": "MCC Code",
    "vat_rate_pct": "VAT Rate (%)", "eab_current": "Current EAB (EUR)", "eab_new": "New EAB (EUR)",
    "export_units": "Export Units (kWh)", "ceg_export_start": "CEG Export Start", "ceg_export_end": "CEG Export End",
    "standing_charge_rate": "Standing Charge Rate (EUR/day)", "pso_levy": "PSO Levy (EUR)",
    "vat_amount": "VAT Amount (EUR)", "subtotal_before_vat": "Subtotal Before VAT (EUR)",
}
PER_KWH = ["day_rate", "night_rate", "peak_rate", "export_rate"]
EUROS = ["day_cost", "night_cost", "peak_cost", "standing_charge_total", "discount", "total_this_period", "export_credit",
         "previous_balance", "payments_received", "amount_due"]


def _text(column: str, style) -> Column:
    if isinstance(style, int):
        return F.format_string(f"%.{style}f", F.round(F.col(column), style))
    return F.date_format(column, style) if style else F.col(column).cast("string")


def summary_rows(stats: DataFrame, skip_missing: bool = False) -> DataFrame:
    """(mprn, row_no, metric, value): the summary as printed rows, optionally without unknown values."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("metric"), _text(c, style).alias("value"))
        for label, c, style in SUMMARY_ROWS if c in stats.columns
    ])
    out = stats.select("mprn", F.posexplode(rows).alias("row_no", "r")).select("mprn", "row_no", "r.*")
    return out.filter(F.col("value").isNotNull()) if skip_missing else out


def meter_tables(readings: DataFrame, stats: DataFrame, raw: bool = False) -> dict[str, DataFrame]:
    """Tables of an interval meter report."""
    tables = {
        "summary": summary_rows(stats),
        "hourly": profiles.hourly_import_export(readings).select("mprn", "hour", "avg_import_kwh", "avg_export_kwh",
                                                                  "avg_import_kw"),
        "daily": profiles.daily_totals(readings),
        "monthly": profiles.monthly_totals(readings),
        "tariff": profiles.tariff_breakdown(readings).filter("kwh > 0"),
    }
    if raw:
        tables["raw"] = readings.select("mprn", "datetime", "import_kwh", "export_kwh", "tariff_period")
    return tables


def meter_tables_flexible(readings: DataFrame, stats: DataFrame, raw: bool = False) -> dict[str, DataFrame]:
    """Tables of a report on daily or monthly series: only what the series supports."""
    tables = {
        "summary": summary_rows(stats.drop("peak_time"), skip_missing=True),
        "daily": profiles.daily_totals(readings.filter(F.col("date").isNotNull())),
        "monthly": profiles.monthly_totals(readings),
    }
    if raw:
        tables["raw"] = readings.select("mprn", "datetime", "import_kwh", "export_kwh")
    return tables


def _label(field: str) -> str:
    plain = field.replace("_", " ").title()
    suffix = " (EUR/kWh)" if field in PER_KWH else " (EUR)" if field in EUROS else ""
    return UNIT_SUFFIXES.get(field, plain + suffix)


def bill_rows(bills: DataFrame, key: str = "bill_id") -> DataFrame:
    """(key, part, row_no, field, value): each bill as printed rows, then four rows on its extraction."""
    fields = [c for c in bills.columns if c not in (key, *bl.BILL_METADATA)]
    body = [F.struct(F.lit("bill").alias("part"), F.lit(_label(c)).alias("field"), F.col(c).cast("string").alias("value"))
            for c in fields]
    warnings = F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).otherwise("None")
    extraction = [
        ("Extraction Method", F.col("extraction_method")),
        ("Confidence Score", F.format_string("%.1f%%", F.col("confidence_score") * 100)),
        ("Warnings", warnings),
        ("Supplier Detected", F.coalesce("supplier", F.lit("Unknown"))),
    ]
    tail = [F.struct(F.lit("extraction").alias("part"), F.lit(n).alias("field"), v.cast("string").alias("value"))
            for n, v in extraction]
    rows = bills.select(key, F.posexplode(F.array(*body, *tail)).alias("row_no", "r"))
    return rows.select(key, "row_no", "r.*")


def comparison_tables(rows: DataFrame, bills: DataFrame, by: Sequence[str] = (), key: str = "bill_idx") -> dict[str, DataFrame]:
    """Comparison with its totals row, and every bill as field and value rows."""
    fields = [c for c in bills.columns if c not in (key, "filename", *bl.BILL_METADATA)]
    pairs = F.array(*[
        F.struct(F.lit(c.replace("_", " ").title()).alias("field"), F.col(c).cast("string").alias("value")) for c in fields
    ])
    sheets = bills.select(key, F.col("filename").alias("sheet"), F.posexplode(pairs).alias("row_no", "r"))
    return {"comparison": bl.with_totals(rows, by), "bills": sheets.select(key, "sheet", "row_no", "r.*")}


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """One folder per table.  Partition only by columns with few values: a folder per meter does not scale."""
    for name, table in tables.items():
        parts = [c for c in partition_by if c in table.columns]
        writer = table.write.mode("overwrite").format(fmt)
        (writer.partitionBy(*parts) if parts else writer).save(f"{path}/{name}")

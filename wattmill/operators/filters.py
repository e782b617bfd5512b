"""Date, tariff, meter and bill filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days to step back from the last date of the data.
METER_PRESETS = {"7d": 6, "30d": 29, "90d": 89, "6m": 182, "12m": 364}
BILL_PRESETS = {"6m": 182, "12m": 364}
BILL_PRESET_SPAN = {"12m": 365, "6m": 182}
NO_MPRN_LABEL = "(No MPRN)"
USABLE_STATUS = ["success", "manual"]


def by_period(
    readings: DataFrame,
    preset: str = "all",
    start: dt.date | None = None,
    end: dt.date | None = None,
    key: str = "mprn",
) -> DataFrame:
    """Keep a preset period counted back from each meter's own last date, or a custom range.

    The last date per meter is a small aggregate joined back, so rows of one meter stay spread out.
    """
    if preset == "all":
        return readings
    if preset == "custom":
        return between_dates(readings, start, end)
    last = readings.groupBy(key).agg(F.max("date").alias("last_date"))
    cutoff = F.date_sub(F.col("last_date"), METER_PRESETS[preset])
    return readings.join(last, key).filter(F.col("date") >= cutoff).drop("last_date")


def between_dates(readings: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Inclusive date range with literal bounds, which reach the scan when `date` is stored."""
    out = readings
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end))
    return out


def by_tariff(readings: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Chosen tariff periods; choosing none keeps nothing."""
    if not periods:
        return readings.filter(F.lit(False))
    return readings.filter(F.col("tariff_period").isin(list(periods)))


def by_mprn(df: DataFrame, selected: Sequence[str], column: str = "mprn") -> DataFrame:
    """Chosen meters, with a label standing for null and blank ones."""
    if column not in df.columns:
        return df
    if not selected:
        return df.filter(F.lit(False))
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    keep = value.isin([m for m in selected if m != NO_MPRN_LABEL])
    if NO_MPRN_LABEL in selected:
        keep = keep | (value == "")
    return df.filter(keep)


def _last_date(bills: DataFrame, by: Sequence[str]) -> DataFrame:
    grouped = bills.groupBy(*by) if by else bills.groupBy()
    return grouped.agg(F.min("sort_date").alias("first_date"), F.max("sort_date").alias("last_date"))


def bills_by_period(
    bills: DataFrame,
    preset: str = "all",
    start: dt.date | None = None,
    end: dt.date | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Bills of a period; undated bills are always kept.  `by` names the comparison set."""
    if preset == "all":
        return bills
    day = F.col("sort_date")
    if preset == "custom":
        return bills.filter(day.isNull() | day.between(F.lit(start), F.lit(end)))
    last = _last_date(bills, by).drop("first_date")
    if by:
        joined, latest = bills.join(last, list(by)), F.col("last_date")
    else:
        joined, latest = bills, last.scalar()
    return joined.filter(day.isNull() | (day >= F.date_sub(latest, BILL_PRESETS[preset]))).drop("last_date")


def available_presets(bills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which presets make sense for the span of dated bills."""
    span = F.datediff("last_date", "first_date")
    offers = [F.when(span >= days, F.lit(name)) for name, days in BILL_PRESET_SPAN.items()]
    return _last_date(bills, by).select(
        *by, span.alias("span_days"), F.filter(F.array(*offers), lambda p: p.isNotNull()).alias("presets")
    )


def usable_bills(bills: DataFrame, included: DataFrame | None = None) -> DataFrame:
    """Bills that were read or typed in; optionally only those whose filename is listed in `included`."""
    out = bills.filter(F.col("status").isin(USABLE_STATUS))
    return out if included is None else out.join(included.select("filename").distinct(), "filename", "left_semi")

"""Calendar, time-zone and tariff-period expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattmill.constants import DAY_NAMES, MONTH_NAMES


def _name_of(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def tariff_period(hour: Column) -> Column:
    """Night 23-08, Peak 17-19, Day otherwise; null hour gives null."""
    return (
        F.when((hour >= 23) | (hour < 8), "Night")
        .when((hour >= 17) & (hour < 19), "Peak")
        .when(hour.isNotNull(), "Day")
    )


def day_name(day: Column) -> Column:
    return _name_of(DAY_NAMES, F.weekday(day) + 1)


def month_name(day: Column) -> Column:
    return _name_of(MONTH_NAMES, F.month(day))


def year_month(day: Column) -> Column:
    return F.date_format(day.cast("date"), "yyyy-MM")


def dublin_wall_to_utc(wall: Column, zone: str = "Europe/Dublin") -> Column:
    """Instant of a local wall time: the repeated autumn hour is its second (winter) pass and
    the missing spring hour moves forward to the change.  Needs session time zone UTC.
    """
    local = wall.cast("timestamp")
    first = F.to_utc_timestamp(local, zone)
    later = first + F.expr("INTERVAL 1 HOUR")
    return (
        F.when(F.from_utc_timestamp(first, zone) != local, F.date_trunc("hour", first))
        .when(F.from_utc_timestamp(later, zone) == local, later)
        .otherwise(first)
    )


def utc_to_dublin_wall(instant: Column, zone: str = "Europe/Dublin") -> Column:
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Seconds as DOUBLE, microseconds kept."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)

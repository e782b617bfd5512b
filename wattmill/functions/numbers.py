"""Guarded number parsing and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"


def to_number(text: Column) -> Column:
    """DOUBLE from a plain decimal string, null otherwise (rejects '1.5d', '0x10', 'NaN')."""
    return F.regexp_extract(text, PLAIN_NUMBER, 1).try_cast("double")


def clean_amount(text: Column) -> Column:
    """Drop currency signs, commas and blanks, then parse."""
    return to_number(F.regexp_replace(text, r"(?U)[€$£,\s]", ""))


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null on a zero or null divisor."""
    return F.try_divide(top, bottom)


def mean_of(total: Column, count: Column) -> Column:
    return F.try_divide(total, count)

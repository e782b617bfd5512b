"""Date parsing: recognise the layout, rewrite it in ISO order, cast once.

No formatter is tried and failed row by row; a text that fits no layout costs a few regex tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.constants import MONTH_NAMES
from wattmill.functions.steps import staged

CENTURY_PIVOT = 69

# One pattern per kind of text.  Groups that take no part in a match come out empty, so every layout is
# rewritten to `#year~month~day~time` by the same replacement.
_MONTH_WORD = "(?:" + "|".join(f"{n[:3]}(?:{n[3:]})?" if len(n) > 3 else n for n in MONTH_NAMES) + ")"
_SEPARATED = r"(\d{1,2})(?:/(\d{1,2})/|-(\d{1,2})-|\.(\d{1,2})\.)(\d{4}|\d{2})"
_WORDED = rf"(\d{{1,2}}) (?=(?i:{_MONTH_WORD}) )([A-Za-z]{{3}})[A-Za-z]* (\d{{4}}|\d{{2}})"
_TIME = r"(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?"
LAYOUTS = {
    # d/m/y, d-m-y, d.m.y, day month-name year (2 or 4 digit years), or y-m-d
    "bill": (rf"^(?:{_SEPARATED}|{_WORDED}|(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}))$", "#$5$8$9~$2$3$4$7$10~$1$6$11~"),
    # the same with an optional time of day, and y/m/d
    "day_first": (
        rf"^(?:{_SEPARATED}|{_WORDED}|(\d{{4}})[/\-](\d{{1,2}})[/\-](\d{{1,2}})){_TIME}$",
        "#$5$8$9~$2$3$4$7$10~$1$6$11~$12",
    ),
    "month_first": (rf"^{_SEPARATED}{_TIME}$", "#$5~$1~$2$3$4~$6"),
}


def squeeze(text: Column) -> Column:
    """Trim, and make every run of blanks one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def with_dates(df: DataFrame, dates: dict[str, str], layout: str = "bill") -> DataFrame:
    """Add a parsed column per entry of `dates` (new name to text column), null where nothing fits.

    "bill" gives DATE, the other layouts TIMESTAMP_NTZ.  The parts and the dates are steps of their own, so each text
    is matched once however often its parts are used, and no filter on a date repeats the parsing.
    """
    pattern, rewrite = LAYOUTS[layout]
    months = F.create_map(*[F.lit(x) for i, n in enumerate(MONTH_NAMES, 1) for x in (n[:3].lower(), str(i))])
    out = staged(df, {
        f"_{new}": F.split(F.regexp_replace(squeeze(F.col(text)), pattern, rewrite), "[#~]") for new, text in dates.items()
    })

    def assemble(parts: Column) -> Column:
        year, month = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        century = F.when(F.length(year) == 4, "").when(year >= str(CENTURY_PIVOT), "19").otherwise("20")
        text = F.concat(
            century, year, F.lit("-"), F.coalesce(F.try_element_at(months, F.lower(month)), month), F.lit("-"),
            F.get(parts, F.lit(3)), F.lit(" "), F.get(parts, F.lit(4)),
        )
        return text.try_cast("date" if layout == "bill" else "timestamp_ntz")

    return staged(out, {new: assemble(F.col(f"_{new}")) for new in dates}).drop(*[f"_{new}" for new in dates])


def parse_read_time(text: Column) -> Column:
    """Local wall time of a meter read: dd-MM-yyyy HH:mm or dd/MM/yyyy HH:mm."""
    layout = r"^(\d{1,2})([/\-])(\d{1,2})\2(\d{4}) (\d{1,2}:\d{2})$"
    trimmed = F.trim(text)
    return F.when(
        trimmed.rlike(layout), F.regexp_replace(trimmed, layout, "$4-$3-$1 $5").try_cast("timestamp_ntz")
    )


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Days shared by two periods whose last day does not count, never negative."""
    return F.greatest(F.lit(0), F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)))

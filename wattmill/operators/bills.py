"""Bill metrics, comparison of many bills, and pro-ration into calendar months.

`by` names the columns of the comparison set, for example the client; without it all bills form one set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.functions.dates import with_dates
from wattmill.functions.numbers import ratio
from wattmill.operators.ranking import number_rows

# The fields a user may edit, numeric ones with their type.
EDITABLE_TEXT = ["supplier", "mprn", "bill_date", "billing_period_start", "billing_period_end"]
EDITABLE_NUMBERS = ["day_rate", "night_rate", "standing_charge_total", "total_this_period", "amount_due"]
PRORATED = ["total_cost", "total_kwh", "day_kwh", "night_kwh", "peak_kwh", "standing_charge", "subtotal"]
SUMMED = ["total_kwh", "day_kwh", "night_kwh", "peak_kwh", "standing_charge", "subtotal", "vat", "total_cost",
          "amount_due", "billing_days"]
AVERAGED = ["day_rate", "night_rate", "peak_rate", "standing_charge_rate", "cost_per_day", "kwh_per_day",
            "effective_rate", "annualised_cost"]
RATE_LABELS = [("Day", "day_rate"), ("Night", "night_rate"), ("Peak", "peak_rate"),
               ("Effective (blended)", "effective_rate"), ("Standing (€/day)", "standing_charge_rate")]
SECTIONS = {
    "Account": ["supplier", "customer_name", "mprn", "gprn", "account_number", "meter_number", "invoice_number"],
    "Billing": ["bill_date", "billing_period_start", "billing_period_end"],
    "Consumption": ["day_units_kwh", "night_units_kwh", "peak_units_kwh", "total_units_kwh"],
    "Costs": ["day_cost", "night_cost", "peak_cost", "subtotal_before_vat", "standing_charge_total", "pso_levy",
              "vat_amount", "total_this_period"],
    "Balance": ["previous_balance", "payments_received", "amount_due"],
}
BILL_METADATA = ["extraction_method", "confidence_score", "warnings"]
HIGH_PCT, PARTIAL_PCT = 80, 60


def billing_days(bills: DataFrame) -> DataFrame:
    """Add parsed period ends and the days between them."""
    dated = with_dates(bills, {"period_start": "billing_period_start", "period_end": "billing_period_end"})
    return dated.withColumn("billing_days", F.datediff("period_end", "period_start"))


def overlay_edits(bills: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits(bill_idx, field_name, value STRING): an edited value replaces the original."""
    names = [*EDITABLE_TEXT, *EDITABLE_NUMBERS]
    wide = edits.groupBy("bill_idx").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(f"edited_{n}") for n in names]
    )
    joined = bills.join(wide, "bill_idx", "left")
    values = {n: F.coalesce(F.col(f"edited_{n}"), F.col(n)) for n in EDITABLE_TEXT}
    values |= {n: F.coalesce(F.col(f"edited_{n}").try_cast("double"), F.col(n)) for n in EDITABLE_NUMBERS}
    return joined.withColumns(values).drop(*[f"edited_{n}" for n in names])


def _known(value: Column) -> Column:
    """The value unless it is missing or zero."""
    return F.when(value != 0, value)


def comparison_rows(bills: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per bill with parsed dates and per-day, per-kWh and annualised figures.

    Zero amounts count as missing in the derived figures.
    """
    start_text, end_text = F.col("billing_period_start"), F.col("billing_period_end")
    dated = with_dates(billing_days(bills), {"parsed_bill_date": "bill_date"})
    rows = dated.select(
        "bill_idx", "filename", *keep,
        F.when(F.col("supplier") != "", F.col("supplier")).otherwise("Unknown").alias("supplier"),
        F.coalesce("mprn", F.lit("")).alias("mprn"),
        F.coalesce("bill_date", F.lit("")).alias("bill_date"),
        F.when((start_text != "") & (end_text != ""), F.concat_ws(" — ", start_text, end_text)).otherwise("")
        .alias("billing_period"),
        F.coalesce("period_start", "parsed_bill_date").alias("sort_date"),
        "period_start", "period_end", "parsed_bill_date", "billing_days",
        F.col("total_units_kwh").alias("total_kwh"),
        F.col("day_units_kwh").alias("day_kwh"),
        F.col("night_units_kwh").alias("night_kwh"),
        F.col("peak_units_kwh").alias("peak_kwh"),
        "day_rate", "night_rate", "peak_rate",
        F.col("standing_charge_total").alias("standing_charge"),
        "standing_charge_rate",
        F.col("subtotal_before_vat").alias("subtotal"),
        F.col("vat_amount").alias("vat"),
        F.col("total_this_period").alias("total_cost"),
        "amount_due",
        F.col("confidence_score").alias("confidence"),
        "fuel_type",
    )
    days = F.when(F.col("billing_days") > 0, F.col("billing_days"))
    cost, kwh = _known(F.col("total_cost")), _known(F.col("total_kwh"))
    return rows.withColumns(
        {
            "cost_per_day": cost / days,
            "kwh_per_day": kwh / days,
            "effective_rate": cost / F.when(kwh > 0, kwh),
        }
    ).withColumn("annualised_cost", F.col("cost_per_day") * 365)


def short_label() -> Column:
    """Month of the period, else of the bill date, else the start of the bill date or file name."""
    return F.coalesce(
        F.date_format("period_start", "MMM yyyy"),
        F.date_format("parsed_bill_date", "MMM yyyy"),
        F.when(F.col("bill_date") != "", F.substring("bill_date", 1, 10)),
        F.substring("filename", 1, 20),
    )


def with_labels(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels, numbered in date order where several bills of a set share one."""
    numbered = number_rows(rows.withColumn("label", short_label()), [*by, "label"], "sort_date", "bill_idx")
    unique = F.when(
        F.col("group_rows") > 1, F.format_string("%s (%d)", F.col("label"), F.col("position"))
    ).otherwise(F.col("label"))
    return numbered.withColumn("label", unique).drop("position", "group_rows")


def in_date_order(rows: DataFrame) -> DataFrame:
    """Sorted for output, undated bills last."""
    return rows.orderBy(F.col("sort_date").asc_nulls_last(), "bill_idx")


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def summary_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals with their coverage, blended rate and mean daily and annual figures, per comparison set."""
    return _grouped(rows, by).agg(
        F.count("*").alias("bills"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.count("total_cost").alias("bills_with_cost"),
        F.coalesce(F.sum("total_kwh"), F.lit(0.0)).alias("total_kwh"),
        F.count("total_kwh").alias("bills_with_kwh"),
        F.when(
            (F.sum("total_kwh") > 0) & (F.sum("total_cost") > 0), F.sum("total_cost") / F.sum("total_kwh")
        ).alias("blended_rate"),
        F.avg("annualised_cost").alias("avg_annualised_cost"),
        F.avg("cost_per_day").alias("avg_cost_per_day"),
        F.avg("kwh_per_day").alias("avg_kwh_per_day"),
        F.avg("total_cost").alias("avg_cost_per_bill"),
        F.sum("billing_days").alias("days_covered"),
        (F.count("*") - F.count("total_cost")).alias("bills_without_cost"),
    )


def month_segments(rows: DataFrame) -> DataFrame:
    """One row per bill and calendar month of its period (last day excluded), with the days in that month."""
    start, end = F.col("period_start"), F.col("period_end")
    spans = rows.filter(end > start)
    months = F.sequence(F.trunc(start, "MM"), F.trunc(F.date_sub(end, 1), "MM"), F.expr("INTERVAL 1 MONTH"))
    month = F.col("month")
    days = F.datediff(F.least(F.add_months(month, 1), end), F.greatest(month, start))
    return spans.withColumn("month", F.explode(months)).withColumn("days", days)


def monthly_prorated(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Amounts of every bill spread over its months by days, summed per month; all-missing stays missing."""
    segments = month_segments(rows)
    share = F.col("days") / F.datediff("period_end", "period_start")
    months = segments.groupBy(*by, "month").agg(
        *[F.sum(F.col(c) * share).alias(c) for c in PRORATED], F.sum("days").alias("days_covered")
    )
    return months.withColumns(
        {
            "month_label": F.date_format("month", "MMM yyyy"),
            "cost_per_day": ratio(F.col("total_cost"), F.col("days_covered")),
            "kwh_per_day": ratio(F.col("total_kwh"), F.col("days_covered")),
        }
    )


def _change(first: Column, last: Column) -> tuple[Column, Column]:
    delta = last - first
    return delta, F.when(first != 0, delta / first * 100).otherwise(0.0)


def first_to_last(rows: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First and last known value of a column in the given order and the change between them (2 values needed)."""
    # The order columns have no nulls after the date default, so both ends are plain extremes.
    filled = [F.coalesce(F.col(c), F.lit("9999-12-31").cast("date")) if c == "sort_date" else F.col(c) for c in order]
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(filled)])
    known = rows.filter(F.col(column).isNotNull())
    ends = _grouped(known, by).agg(
        F.min_by(column, at).alias("first_value"), F.max_by(column, at).alias("last_value"),
        F.count("*").alias("values"),
    ).filter("values >= 2")
    delta, pct = _change(F.col("first_value"), F.col("last_value"))
    return ends.withColumn("change", delta).withColumn("change_pct", pct)


def rate_changes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last of the five rates, in one pass over the bills."""
    long = rows.select(
        *by, "sort_date", "bill_idx",
        F.posexplode(F.array(*[
            F.struct(F.lit(label).alias("tariff"), F.col(c).alias("rate")) for label, c in RATE_LABELS
        ])).alias("tariff_no", "r"),
    ).select(*by, "sort_date", "bill_idx", "tariff_no", "r.tariff", "r.rate")
    return first_to_last(long, "rate", ["sort_date", "bill_idx"], [*by, "tariff_no", "tariff"])


def totals_row(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the amounts and mean of the rates of a set, shaped like a comparison row."""
    return _grouped(rows, by).agg(
        F.lit("TOTAL / AVG").alias("filename"),
        *[F.sum(c).alias(c) for c in SUMMED],
        *[F.avg(c).alias(c) for c in AVERAGED],
    )


def with_totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Comparison rows followed by their totals row."""
    columns = [*by, "filename", *SUMMED, *AVERAGED]
    return rows.select(*columns).unionByName(totals_row(rows, by).select(*columns))


def has_tariff_split(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(rows, by).agg(
        *[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("day_kwh", "night_kwh", "peak_kwh")]
    )


def confidence_band(score: Column) -> Column:
    """Band of a 0 to 1 score, rounded to whole percent first."""
    pct = F.bround(score * 100)
    return F.when(pct >= HIGH_PCT, "high").when(pct >= PARTIAL_PCT, "partial").otherwise("low")


def field_coverage(bills: DataFrame) -> DataFrame:
    """Known fields per bill, overall and per section; columns a table lacks count as unknown."""
    def known(columns: Sequence[str]) -> Column:
        present = [F.col(c).isNotNull().cast("int") for c in columns if c in bills.columns]
        return sum(present, F.lit(0))

    every = [c for c in bills.columns if c not in (*BILL_METADATA, "bill_idx", "filename", "status", "client_id")]
    sections = {f"{name.lower()}_fields": known(fields) for name, fields in SECTIONS.items()}
    total = sum(sections.values(), F.lit(0))
    return bills.select(
        "bill_idx", known(every).alias("field_count"), *[c.alias(n) for n, c in sections.items()],
        total.alias("section_fields"), F.lit(sum(len(f) for f in SECTIONS.values())).alias("section_expected"),
    )


# ---------------------------------------------------------------- nested bills

LINE_ITEM = ("struct<description:string,line_total:double,quantity:double,unit:string,unit_price:double,"
             "vat_rate:double,vat_amount:double>")
GENERIC_BILL = (
    "provider string, invoice_number string, account_number string, mprn string, gprn string, invoice_date string, "
    f"billing_period string, due_date string, line_items array<{LINE_ITEM}>, subtotal double, vat_amount double, "
    "vat_rate double, total_incl_vat double, fuel_type string, extraction_method string, confidence_score double, "
    "raw_text string, warnings array<string>"
)


def bills_to_json(bills: DataFrame, key: str = "bill_id") -> DataFrame:
    names = [f.strip().split(" ")[0] for f in GENERIC_BILL.replace(f"array<{LINE_ITEM}>", "items").split(", ")]
    return bills.select(key, F.to_json(F.struct(*names)).alias("json"))


def bills_from_json(texts: DataFrame, key: str = "bill_id") -> DataFrame:
    """Parse bill JSON; keys the schema does not know are dropped."""
    return texts.select(key, F.from_json("json", GENERIC_BILL).alias("b")).select(key, "b.*")


def _kind_of_item(description: Column) -> Column:
    text = F.lower(description)
    return (
        F.when(text.contains("day") & ~text.contains("stand"), "day")
        .when(text.contains("night"), "night")
        .when(text.contains("peak"), "peak")
        .when(text.contains("standing"), "standing")
        .when(text.contains("pso") | text.contains("public service"), "pso")
        .when(text.contains("discount"), "discount")
        .when(text.contains("export"), "export")
    )


def _period_ends(period: Column) -> tuple[Column, Column]:
    def cut(separator: str) -> tuple[Column, Column]:
        at = F.instr(period, separator)
        left = F.when(at > 0, F.trim(F.substring(period, F.lit(1), at - 1)))
        right = F.when(at > 0, F.trim(F.substring(period, at + len(separator), F.length(period))))
        return left, right

    dash, to, bare = cut(" - "), cut(" to "), cut("-")
    usable = F.length(bare[0]) > 4
    return (
        F.coalesce(dash[0], to[0], F.when(usable, bare[0])),
        F.coalesce(dash[1], to[1], F.when(usable, bare[1])),
    )


def flatten_bills(bills: DataFrame) -> DataFrame:
    """Nested bills to the flat layout; of several line items of one kind the last counts.

    Works on the line-item array in place, so nothing is shuffled.
    """
    kinds = F.transform("line_items", lambda i: F.struct(_kind_of_item(i["description"]).alias("kind"), i.alias("item")))
    staged = bills.withColumn("_kinds", kinds)

    def last(kind: str) -> Column:
        return F.try_element_at(F.filter("_kinds", lambda k: k["kind"] == kind), F.lit(-1))["item"]

    staged = staged.withColumns({f"_{k}": last(k) for k in ("day", "night", "peak", "pso", "discount", "export")})
    # Standing days keep the last known quantity even when a later item has none.
    standing = F.filter("_kinds", lambda k: k["kind"] == "standing")
    standing_days = F.try_element_at(
        F.filter(standing, lambda k: k["item"]["quantity"].isNotNull()), F.lit(-1)
    )["item"]["quantity"].cast("int")
    start, end = _period_ends(F.col("billing_period"))
    units = [F.col(f"_{k}")["quantity"] for k in ("day", "night", "peak")]
    total = sum((F.coalesce(u, F.lit(0.0)) for u in units), F.lit(0.0))
    tariff = [
        F.col(f"_{k}")[source].alias(f"{k}_{name}")
        for k in ("day", "night", "peak")
        for source, name in (("quantity", "units_kwh"), ("unit_price", "rate"), ("line_total", "cost"))
    ]
    return staged.select(
        "bill_id",
        F.when(F.col("provider") != "", F.col("provider")).alias("supplier"),
        "fuel_type", "mprn", "gprn", "account_number", "invoice_number",
        F.col("invoice_date").alias("bill_date"), F.col("due_date").alias("payment_due_date"),
        start.alias("billing_period_start"), end.alias("billing_period_end"),
        *tariff,
        F.when(F.coalesce(*units).isNotNull(), F.round(total, 3)).alias("total_units_kwh"),
        F.try_element_at(standing, F.lit(-1))["item"]["line_total"].alias("standing_charge_total"),
        standing_days.alias("standing_charge_days"),
        F.try_element_at(standing, F.lit(-1))["item"]["unit_price"].alias("standing_charge_rate"),
        F.col("_pso")["line_total"].alias("pso_levy"),
        F.col("_discount")["line_total"].alias("discount"),
        F.col("_export")["quantity"].alias("export_units"),
        F.col("_export")["unit_price"].alias("export_rate"),
        F.col("_export")["line_total"].alias("export_credit"),
        F.col("subtotal").alias("subtotal_before_vat"), "vat_amount", F.col("vat_rate").alias("vat_rate_pct"),
        F.col("total_incl_vat").alias("total_this_period"),
        "extraction_method", "confidence_score", "warnings",
    )

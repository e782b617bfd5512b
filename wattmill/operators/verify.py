"""Bills against meter readings: is the pair comparable, how much was metered, what should it have cost.

Bills and readings are paired by MPRN. Where both carry a `case_id`, a bill is only compared with the meters of its
case, and a bill without an MPRN with the one meter of its case, if there is one alone. Readings are reduced to one row
per meter and date before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattmill.constants import EXPORT_RATE_EUR
from wattmill.functions.dates import with_dates
from wattmill.functions.numbers import ratio
from wattmill.reference_tables import tariff_presets

HALF_COVERED_PCT, FULLY_COVERED_PCT = 50, 100
MATCH_PCT, REVIEW_PCT = 5, 15
METERED = ["total", "day", "night", "peak", "export"]
# Daily sums are kept as exact decimals, so that running totals can be subtracted without rounding errors.
EXACT = "decimal(28,9)"


def _cased(df: DataFrame, by_case: bool) -> DataFrame:
    """df with `case_id`; without cases each MPRN is a case, and rows without one have none."""
    return df if by_case else df.withColumn("case_id", F.nullif(F.trim("mprn"), F.lit("")))


def _by_case(bills: DataFrame, readings: DataFrame) -> bool:
    return "case_id" in bills.columns and "case_id" in readings.columns


def case_meters(readings: DataFrame) -> DataFrame:
    """(case_id, hdf_mprn, hdf_start, hdf_end): the meters of each case and their ranges of dates."""
    return readings.groupBy("case_id", F.trim("mprn").alias("hdf_mprn")).agg(
        F.min(F.col("datetime").cast("date")).alias("hdf_start"),
        F.max(F.col("datetime").cast("date")).alias("hdf_end"),
    )


def _paired(bills: DataFrame, meters: DataFrame) -> DataFrame:
    """Bills with the meter they name in their case, else the only meter of the case, and the number of meters there."""
    meter = F.struct("hdf_mprn", "hdf_start", "hdf_end")
    cases = meters.groupBy("case_id").agg(F.count("*").alias("meters"), F.min(meter).alias("_one"))
    named = meters.select("case_id", F.col("hdf_mprn").alias("_mprn"), meter.alias("_own"))
    joined = bills.withColumn("_mprn", F.trim("mprn")).join(cases, "case_id", "left").join(
        named, ["case_id", "_mprn"], "left")
    chosen = F.coalesce("_own", F.when(F.col("meters") == 1, F.col("_one")))
    return joined.withColumns({c: chosen[c] for c in ("hdf_mprn", "hdf_start", "hdf_end")}).drop("_own", "_one", "_mprn")


def validate(bills: DataFrame, readings: DataFrame) -> DataFrame:
    """Bills with the outcome of the checks in order: meter, dates, period length, overlap.

    `override_start` and `override_end`, where the bills have them, replace the printed dates.
    """
    dated = with_dates(bills, {"printed_start": "billing_period_start", "printed_end": "billing_period_end"})
    for end in ("start", "end"):
        override = [F.col(f"override_{end}")] if f"override_{end}" in bills.columns else []
        dated = dated.withColumn(f"bill_{end}", F.coalesce(*override, F.col(f"printed_{end}")))
    # One row per case and meter on the other side, so a case with very many bills can be split freely.
    by_case = _by_case(bills, readings)
    joined = _paired(_cased(dated, by_case), case_meters(_cased(readings, by_case)))

    unnamed = F.coalesce(F.trim("mprn"), F.lit("")) == ""
    compared = ~unnamed & (F.col("meters") > 0)
    same = F.coalesce(F.col("hdf_mprn") == F.trim("mprn"), F.lit(False))
    mismatch = F.coalesce(compared & ~same, F.lit(False))
    undated = F.col("bill_start").isNull() | F.col("bill_end").isNull()
    days = F.datediff("bill_end", "bill_start")
    overlap = F.greatest(F.lit(0), F.datediff(
        F.least("bill_end", "hdf_end"), F.greatest("bill_start", "hdf_start")))
    reason = (
        F.when(mismatch, "meter mismatch")
        .when(undated, "no billing period")
        .when(F.col("case_id").isNull(), "no MPRN and no case")
        .when(unnamed & (F.col("meters") > 1), "no MPRN and several meters")
        .when(F.col("hdf_start").isNull(), "no meter readings")
        .when(F.col("billing_days") <= 0, "period ends before it starts")
        .when(F.col("overlap_days") == 0, "no overlap")
    )
    pct = F.col("overlap_pct")
    open_case = F.col("block_reason").isNull()
    issues = F.array(
        F.when(unnamed, "no MPRN on the bill, matched by date"),
        F.when(open_case & (pct < HALF_COVERED_PCT), "less than half of the period is metered"),
        F.when(open_case & (pct < FULLY_COVERED_PCT), "part of the period is not metered"),
    )
    return (
        joined.withColumns({
            "mprn_skipped": unnamed, "mprn_match": F.coalesce(compared & same, F.lit(False)),
            "billing_days": F.when(~mismatch & ~undated & F.col("hdf_start").isNotNull(), days).otherwise(0),
        })
        .withColumn("overlap_days", F.when(F.col("billing_days") > 0, overlap).otherwise(0))
        .withColumn("overlap_pct", F.coalesce(ratio(F.col("overlap_days") * 100.0, F.col("billing_days")), F.lit(0.0)))
        .withColumn("block_reason", reason)
        .withColumn("needs_dates", ~mismatch & undated)
        .withColumn("valid", F.col("block_reason").isNull())
        .withColumn("issues", F.filter(issues, lambda i: i.isNotNull()))
        .drop("printed_start", "printed_end", "meters")
    )


def totals_up_to(readings: DataFrame, asked: DataFrame) -> DataFrame:
    """(case_id, hdf_mprn, on_date, sums): metered kWh and reads of a meter up to each asked date, that date included.

    An as-of lookup: the asked dates, each once, are sorted between the daily sums of their meter and take the running
    total of the last day before them. The work follows the days with reads and the asked dates, not the calendar, so
    a read of a wrong year is one more row. Asked dates before the first read get zeros.
    """
    tariff, kwh = F.col("tariff_period"), F.col("import_kwh")
    meter = ["case_id", "hdf_mprn"]
    daily = readings.groupBy("case_id", F.trim("mprn").alias("hdf_mprn"),
                             F.col("datetime").cast("date").alias("on_date")).agg(
        F.sum(kwh).cast(EXACT).alias("total"),
        *[F.coalesce(F.sum(F.when(tariff == p.title(), kwh)), F.lit(0.0)).cast(EXACT).alias(p)
          for p in ("day", "night", "peak")],
        F.sum("export_kwh").cast(EXACT).alias("export"),
        F.count("*").alias("reads"),
    ).withColumn("asked", F.lit(False))
    wanted = asked.filter("on_date is not null").select(*meter, "on_date").distinct().withColumns(
        {**{c: F.lit(0).cast(EXACT) for c in METERED}, "reads": F.lit(0).cast("long"), "asked": F.lit(True)})
    # Days and asked dates of one meter are bounded by its calendar, however many bills ask.
    so_far = Window.partitionBy(*meter).orderBy("on_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.unionByName(wanted).select(
        *meter, "on_date", "asked", F.struct(*[F.sum(c).over(so_far).alias(c) for c in [*METERED, "reads"]]).alias("sums"),
    ).filter("asked").drop("asked")


def metered(validated: DataFrame, readings: DataFrame) -> DataFrame:
    """Bills with the kWh metered from their first to their last date, both included; nulls for bills that are not valid.

    Two lookups of running totals replace a range join: work per bill does not grow with its period, and the bills of
    one case spread over its dates.
    """
    meter = ["case_id", "hdf_mprn"]
    bounded = validated.withColumns({
        "_last": F.when(F.col("valid"), F.least("bill_end", "hdf_end")),
        "_before": F.when(F.col("valid"), F.date_sub(F.greatest("bill_start", "hdf_start"), 1)),
    })
    asked = bounded.select(*meter, F.explode(F.array("_last", "_before")).alias("on_date"))
    totals = totals_up_to(readings, asked)
    upto = totals.select(*meter, F.col("on_date").alias("_last"), F.col("sums").alias("_to"))
    before = totals.select(*meter, F.col("on_date").alias("_before"), F.col("sums").alias("_from"))
    joined = bounded.join(upto, [*meter, "_last"], "left").join(before, [*meter, "_before"], "left")

    def between(name: str) -> Column:
        return F.when(F.col("valid"), F.coalesce(F.col("_to")[name], F.lit(0)) - F.coalesce(F.col("_from")[name], F.lit(0)))

    return joined.withColumns({f"hdf_{c}_kwh": between(c).cast("double") for c in METERED}).withColumn(
        "reads", between("reads")
    ).drop("_to", "_from", "_last", "_before")


def verify(bills: DataFrame, readings: DataFrame) -> DataFrame:
    """Metered kWh, billed kWh and expected costs of every bill; blocked bills keep their reason.

    A valid bill whose dates hold no reading gets an issue and no figures.
    """
    checked = validate(bills, readings)
    joined = metered(checked, _cased(readings, _by_case(bills, readings)))
    has_reads = F.coalesce(F.col("reads") > 0, F.lit(False))
    empty = F.col("valid") & ~has_reads
    joined = joined.withColumn(
        "issues", F.when(empty, F.concat("issues", F.array(F.lit("no readings in the billing period")))).otherwise(
            F.col("issues"))
    ).withColumns({f"hdf_{c}_kwh": F.when(has_reads, F.col(f"hdf_{c}_kwh")).otherwise(0.0) for c in METERED})
    billed = {f"bill_{t}_kwh": F.when(has_reads, F.col(f"{t}_units_kwh")) for t in ("day", "night", "peak", "total")}
    rates = {f"bill_{t}_rate": F.when(has_reads, F.col(f"{t}_rate")) for t in ("day", "night", "peak")}
    costs = {f"expected_cost_{t}": F.when(has_reads, F.col(f"hdf_{t}_kwh") * F.col(f"{t}_rate"))
             for t in ("day", "night", "peak")}
    out = joined.withColumns({**billed, **rates, **costs})
    parts = [F.col(f"expected_cost_{t}") for t in ("day", "night", "peak")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return out.withColumns({
        "expected_cost_total": F.when(F.coalesce(*parts).isNotNull(), total),
        "bill_cost_total": F.when(has_reads, F.col("total_this_period")),
        "bill_standing_days": F.when(has_reads, F.col("standing_charge_days")),
        "bill_standing_total": F.when(has_reads, F.col("standing_charge_total")),
        "bill_export_units": F.when(has_reads, F.col("export_units")),
        "bill_export_credit": F.when(has_reads, F.col("export_credit")),
    }).drop("reads")


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select("bill_idx", F.posexplode(F.array(*structs)).alias("row_no", "r")).select("bill_idx", "row_no", "r.*")


def consumption_deltas(verified: DataFrame) -> DataFrame:
    """Four rows per bill: day, night, peak and total, metered against billed."""
    rows = _rows(verified, [
        F.struct(F.lit(t.title()).alias("period"), F.col(f"hdf_{t}_kwh").alias("meter_kwh"),
                 F.col(f"bill_{t}_kwh").alias("bill_kwh")) for t in ("day", "night", "peak", "total")
    ])
    delta = F.col("bill_kwh") - F.col("meter_kwh")
    return rows.withColumn("delta_kwh", delta).withColumn("delta_pct", ratio(F.col("delta_kwh") * 100, F.col("meter_kwh")))


def rate_comparison(verified: DataFrame) -> DataFrame:
    """Three rows per bill: printed rate against the supplier's preset, null for suppliers without one."""
    presets = tariff_presets(verified.sparkSession).select(
        F.col("provider").alias("supplier"), *[F.col(f"{t}_rate").alias(f"preset_{t}") for t in ("day", "night", "peak")]
    )
    joined = verified.join(F.broadcast(presets), "supplier", "left")
    return _rows(joined, [
        F.struct(F.lit(t.title()).alias("period"), F.col(f"bill_{t}_rate").alias("bill_rate"),
                 F.col(f"preset_{t}").alias("preset_rate")) for t in ("day", "night", "peak")
    ])


def status_band(verified: DataFrame) -> DataFrame:
    """Match, Review or Discrepancy by the total difference; none when either total is missing or zero."""
    meter, bill = F.col("hdf_total_kwh"), F.col("bill_total_kwh")
    pct = F.when((meter != 0) & (bill != 0), F.abs((bill - meter) / meter) * 100)
    return verified.withColumn("delta_pct", pct).withColumn(
        "status",
        F.when(F.col("delta_pct") <= MATCH_PCT, "Match").when(F.col("delta_pct") <= REVIEW_PCT, "Review")
        .when(F.col("delta_pct").isNotNull(), "Discrepancy"),
    )


def cost_rows(verified: DataFrame) -> DataFrame:
    """Expected energy cost per tariff that has a printed rate."""
    return _rows(verified, [
        F.struct(F.lit(f"{t.title()} Energy").alias("component"), F.col(f"hdf_{t}_kwh").alias("meter_kwh"),
                 F.col(f"bill_{t}_rate").alias("bill_rate"), F.col(f"expected_cost_{t}").alias("expected_cost"))
        for t in ("day", "night", "peak")
    ]).filter(F.col("expected_cost").isNotNull())


def cost_difference(verified: DataFrame) -> DataFrame:
    """Billed total less the expected energy cost, where both are known."""
    expected = F.col("expected_cost_total")
    return verified.select("bill_idx", expected, "bill_cost_total", F.when(
        expected != 0, F.col("bill_cost_total") - expected).alias("difference"))


def export_check(verified: DataFrame, rate: float = EXPORT_RATE_EUR) -> DataFrame:
    """Bills with metered export: the credit it should earn against the printed one."""
    return verified.filter("hdf_export_kwh > 0").select(
        "bill_idx", "hdf_export_kwh", "bill_export_units",
        F.when(F.col("bill_export_credit").isNotNull(), F.col("hdf_export_kwh") * rate).alias("expected_credit"),
        "bill_export_credit",
    )


def standing_check(verified: DataFrame) -> DataFrame:
    """Printed standing days against the length of the period."""
    return verified.filter(F.col("bill_standing_days").isNotNull()).select(
        "bill_idx", "bill_standing_days", "billing_days",
        (F.col("bill_standing_days") == F.col("billing_days")).alias("days_match"),
    )

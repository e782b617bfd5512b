"""Tariff rates per meter: presets, custom rates and their normalisation to EUR/kWh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill import constants as C
from wattmill.reference_tables import tariff_presets

RATE_COLUMNS = ("day_rate", "night_rate", "peak_rate")
PERIODS = ("day", "night", "peak")


def default_rates() -> dict[str, float]:
    preset = next(row for row in C.TARIFF_PRESETS if row[0] == C.DEFAULT_PROVIDER)
    return {f"{p}_rate": v / 100 for p, v in zip(PERIODS, preset[1:])}


def normalise_rates(tariffs: DataFrame) -> DataFrame:
    """All three rates are taken as cents when the day rate is above 1."""
    in_cents = F.col("day_rate") > 1
    return tariffs.withColumns({c: F.when(in_cents, F.col(c) / 100).otherwise(F.col(c)) for c in RATE_COLUMNS})


def with_rates(meters: DataFrame, tariffs: DataFrame | None = None) -> DataFrame:
    """Attach EUR rates to one row per meter; meters without a tariff get the default provider's."""
    fallback = default_rates()
    if tariffs is None:
        return meters.withColumns({c: F.lit(v) for c, v in fallback.items()})
    joined = meters.join(normalise_rates(tariffs).select("mprn", *RATE_COLUMNS), "mprn", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fallback.items()})


def always_on_cost_per_kw() -> Column:
    """Yearly cost of 1 kW that never switches off."""
    return sum(
        (F.lit(float(C.TARIFF_HOURS[p])) * F.col(f"{p}_rate") for p in ("night", "peak", "day")), F.lit(0.0)
    )


def blended_rate() -> Column:
    """Rate weighted by the hours of each period in a day."""
    return F.lit(9 / 24) * F.col("night_rate") + F.lit(2 / 24) * F.col("peak_rate") + F.lit(13 / 24) * F.col("day_rate")


def resolve_choice(choices: DataFrame) -> DataFrame:
    """(mprn, provider, day_cents, night_cents, peak_cents): a rate that differs from the provider's preset
    by more than 0.001 cents makes the tariff custom; missing cents take the preset.  Rates come out in EUR.
    """
    presets = tariff_presets(choices.sparkSession).withColumnRenamed("provider", "preset_provider")
    joined = choices.join(F.broadcast(presets), F.col("provider") == F.col("preset_provider"), "left")
    rates = {p: F.coalesce(F.col(f"{p}_cents"), F.col(f"{p}_rate") * 100) for p in PERIODS}
    edited = F.lit(False)
    for p in PERIODS:
        edited = edited | F.coalesce(F.abs(rates[p] - F.col(f"{p}_rate") * 100) > 0.001, F.lit(True))
    return joined.select(
        "mprn",
        F.when(edited, "Custom").otherwise(F.col("provider")).alias("provider"),
        *[(rates[p] / 100).alias(f"{p}_rate") for p in PERIODS],
    )

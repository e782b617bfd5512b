"""One-pass extraction of the flat bill layout, with completeness score and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill.functions.steps import staged
from wattmill.operators.extract import detect_supplier
from wattmill.operators.rules import option, with_found

# Labelled patterns of the flat layout.  Case matters unless the pattern says otherwise.
TEXT_PATTERNS = {
    "mprn": r"\b(10\d{9})\b",
    "account_number": r"Account\s*Number\s*\n?\s*(\d{7,})",
    "invoice_number": r"Invoice\s*No\.?\s*\n?\s*(\d+)",
    "meter_number": r"Meter\s+(\d{7,8})",
    "dg_code": r"\b(DG\d)\b",
    "mcc_code": r"\b(MCC\d+)\b",
    "customer_name": r"((?:Mr|Mrs|Ms|Dr|Miss)\s+(?:.+?))(?:\n|\Z)",
    "premises": r"Premises\s*Supplied:\s*\n?\s*(.+?)(?:\n|\Z)",
    "bill_date": r"Date\s*of\s*this\s*Bill\s*\n?\s*(\d{1,2}\s+\w+\s+\d{4})",
    "payment_due_date": r"Payment\s*Due\s*Date\s*\n?\s*(\d{1,2}\s+\w+\s+\d{4})",
    "contract_end_date": r"Contract\s*End\s*Date\s*\n?\s*(\d{1,2}\s+\w+\s+\d{4})",
    "tariff_type": r"Tariff\s*\n?\s*(Electricity|Gas)",
}
# Fixed values, as above: patterns that give two fields.
PAIR_PATTERNS = {
    ("billing_period_start", "billing_period_end"):
        r"Billing\s*Period\s*\n?\s*(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})",
    ("ceg_export_start", "ceg_export_end"):
        r"CEG\s*Export\s*Period\s*\n?\s*(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})",
}
# Fixed values, as above: patterns of amounts.
NUMBER_PATTERNS = {
    ("day_units_kwh", "day_rate"): r"Day\s+([\d,]+\.\d+)\s*Units?\s*at\s*€([\d.]+)\s*per\s*Unit",
    ("night_units_kwh", "night_rate"): r"Night\s+([\d,]+\.\d+)\s*Units?\s*at\s*€([\d.]+)\s*per\s*Unit",
    ("peak_units_kwh", "peak_rate"): r"Peak\s+([\d,]+\.\d+)\s*Units?\s*at\s*€([\d.]+)\s*per\s*Unit",
    ("day_cost",): r"Day\s+[\d,.]+\s*Units?\s*at\s*€[\d.]+\s*per\s*Unit\s*\n?\s*€([\d,.]+)",
    ("night_cost",): r"Night\s+[\d,.]+\s*Units?\s*at\s*€[\d.]+\s*per\s*Unit\s*\n?\s*€([\d,.]+)",
    ("peak_cost",): r"Peak\s+[\d,.]+\s*Units?\s*at\s*€[\d.]+\s*per\s*Unit\s*\n?\s*€([\d,.]+)",
    ("standing_charge_days", "standing_charge_rate", "standing_charge_total"):
        r"Standing\s*Charge\s+(\d+)\s*days?\s*at\s*€([\d.]+)\s*per\s*day\s*\n?\s*€([\d.]+)",
    ("discount",): r"(?i)discount\s*(?:for\s*this\s*period)?\s*\n?\s*€([\d,.]+)\s*CR",
    ("pso_levy",): r"(?m)Public\s*Service\s*Obligation\s*Levy.*?€([\d.]+)\s*$",
    ("subtotal_before_vat",): r"Sub\s*Total\s*before\s*VAT\s*\n?\s*€([\d,.]+)",
    ("vat_rate_pct", "vat_amount"): r"VAT\s*on\s*€[\d,.]+\s*at\s*(\d+)%\s*\n?\s*€([\d,.]+)",
    ("export_units", "export_rate", "export_credit"):
        r"(?i)Export\s*Units?\s*([\d,.]+)\s*at\s*€(-?[\d.]+)\s*per\s*unit\s*\n?\s*€([\d,.]+)CR",
    ("total_this_period",): r"Total\s*transactions?\s*for\s*this\s*period\s*\n?\s*€([\d,.]+)",
    ("previous_balance",): r"Balance\s*at\s*(?:previous|last)\s*bill\s*\n?\s*€([\d,.]+)",
    ("payments_received",): r"Payment.*?received.*?\n?\s*€([\d,.]+)",
    ("amount_due",): r"New\s*account\s*balance.*?\n?\s*€([\d,.]+)",
    ("eab_current",): r"Current\s*plan\s*EAB\s*€([\d,.]+)",
    ("eab_new",): r"New\s*tariff\s*EAB\s*€([\d,.]+)",
}
# Weight of each field in the completeness score.
WEIGHTS = {
    3: ["mprn", "billing_period_start", "billing_period_end", "total_units_kwh", "total_this_period"],
    2: ["supplier", "account_number", "bill_date", "day_units_kwh", "night_units_kwh", "day_rate", "night_rate",
        "standing_charge_total", "vat_amount", "subtotal_before_vat"],
    1: ["customer_name", "premises", "meter_number", "peak_units_kwh", "peak_rate", "discount", "pso_levy",
        "export_units", "eab_current", "eab_new", "contract_end_date", "payment_due_date"],
}
# Bounds of the warnings.
USUAL_VAT = [9.0, 13.5, 23.0]
KWH_HIGH, KWH_LOW, VAT_GAP, COST_GAP = 10000, 50, 0.10, 0.50


def parse_euro(text: Column) -> Column:
    """Amount with commas dropped and a trailing dot ignored."""
    plain = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\.+$", "")
    return F.regexp_extract(plain, r"^(-?[0-9]*\.?[0-9]+)$", 1).try_cast("double")


def flat_rules() -> list[tuple]:
    """The flat layout as one rule set: a field is a group of its pattern."""
    named = [((name,), p) for name, p in TEXT_PATTERNS.items()] + [*PAIR_PATTERNS.items(), *NUMBER_PATTERNS.items()]
    return [("flat", [(name, [option(p, 1.0, 0, only_group=group, flags="")])
                      for names, p in named for group, name in enumerate(names, 1)])]


def extract_flat(bills: DataFrame, text: str = "text") -> DataFrame:
    """All flat fields of every bill text, total units, completeness score and warnings."""
    sets = flat_rules()
    found = with_found(detect_supplier(bills, text), text, F.lit("flat"), [name for name, _ in sets[0][1]], "_x", sets)

    def value(name: str) -> Column:
        return F.col("_x")[name]["value"]

    fields = {name: F.trim(value(name)) for name in TEXT_PATTERNS}
    fields |= {name: value(name) for names in PAIR_PATTERNS for name in names}
    fields |= {name: parse_euro(value(name)) for names in NUMBER_PATTERNS for name in names}
    fields["standing_charge_days"] = fields["standing_charge_days"].cast("int")
    flat = staged(found, fields).drop("_x")
    units = [F.coalesce(F.col(f"{k}_units_kwh"), F.lit(0.0)) for k in ("day", "night", "peak")]
    total = sum(units[1:], units[0])
    flat = flat.withColumn("total_units_kwh", F.when(total > 0, F.round(total, 3)))
    return flat.withColumn("confidence_score", completeness_score()).withColumn("warnings", flat_warnings())


def completeness_score() -> Column:
    """Weighted share of known fields."""
    gained = [F.when(F.col(f).isNotNull(), w).otherwise(0) for w, fs in WEIGHTS.items() for f in fs]
    full = sum(w * len(fs) for w, fs in WEIGHTS.items())
    return F.round(sum(gained[1:], gained[0]) / full, 3)


def flat_warnings() -> Column:
    """Messages on odd formats, amounts and cross-checks; zero counts as missing."""
    kwh, vat = F.col("total_units_kwh"), F.col("vat_rate_pct")
    expected_vat = F.round(F.col("subtotal_before_vat") * vat / 100, 2)
    all_vat = (F.col("subtotal_before_vat") != 0) & (vat != 0) & (F.col("vat_amount") != 0)
    notes = [
        F.when((F.col("mprn") != "") & ~F.col("mprn").rlike(r"^10\d{9}$"), "MPRN format"),
        F.when(kwh > KWH_HIGH, "Very high consumption"),
        F.when((kwh != 0) & (kwh < KWH_LOW), "Very low consumption"),
        F.when((vat != 0) & ~vat.isin(USUAL_VAT), "Unusual VAT rate"),
        F.when(all_vat & (F.abs(expected_vat - F.col("vat_amount")) > VAT_GAP), "VAT does not match its rate"),
    ]
    for kind in ("day", "night", "peak"):
        units, rate, cost = (F.col(f"{kind}_{part}") for part in ("units_kwh", "rate", "cost"))
        known = (units != 0) & (rate != 0) & (cost != 0)
        notes.append(F.when(known & (F.abs(F.round(units * rate, 2) - cost) > COST_GAP),
                            f"{kind.title()} cost does not match units and rate"))
    notes.append(F.when(F.col("supplier") == "Unknown", "Supplier not identified"))
    notes += [F.when(F.col(f).isNull(), f"Missing: {f}") for f in WEIGHTS[3]]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())

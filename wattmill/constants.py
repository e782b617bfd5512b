"""Fixed values of the energy domain."""

from __future__ import annotations

# Provider presets in cents per kWh (provider, day, night, peak).
TARIFF_PRESETS = [
    ("Electric Ireland", 28.14, 14.79, 30.02),
    ("Energia", 27.81, 15.29, 31.22),
    ("SSE Airtricity", 28.29, 18.18, 31.69),
    ("Bord Gais Energy", 30.23, 22.31, 36.79),
    ("Flogas", 26.02, 18.78, 30.79),
    ("Pinergy", 38.32, 31.77, 41.77),
    ("Custom", 28.14, 14.79, 30.02),
]
DEFAULT_PROVIDER = "Electric Ireland"

# Clean-export rate (EUR/kWh) and tariff hours per year.
EXPORT_RATE_EUR = 0.185
TARIFF_HOURS = {"night": 3285, "peak": 730, "day": 4745}

# Solid, liquid and bottled fuels (fuel, display name, unit, kWh per unit, is default unit).
FUEL_FACTORS = [
    ("coal", "Coal", "tonne", 8140.0, False),
    ("coal", "Coal", "bag_40kg", 325.6, True),
    ("smokeless_coal", "Smokeless Coal", "tonne", 8900.0, False),
    ("smokeless_coal", "Smokeless Coal", "bag_25kg", 222.5, True),
    ("peat_briquettes", "Peat Briquettes", "tonne", 4650.0, False),
    ("peat_briquettes", "Peat Briquettes", "bale_12_5kg", 58.0, True),
    ("wood_pellets", "Wood Pellets", "tonne", 4800.0, True),
    ("wood_logs", "Wood Logs (Seasoned)", "tonne", 3500.0, True),
    ("kerosene", "Kerosene", "litre", 10.35, True),
    ("lpg", "LPG", "litre", 7.08, True),
    ("lpg", "LPG", "kg", 13.6, False),
]
UNIT_LABELS = [
    ("tonne", "Tonne"),
    ("bag_40kg", "Bag (40kg)"),
    ("bag_25kg", "Bag (25kg)"),
    ("bale_12_5kg", "Bale (12.5kg)"),
    ("litre", "Litre"),
    ("kg", "kg"),
]

# Header synonyms per standard field, in priority order.
KNOWN_COLUMNS = {
    "datetime": [
        "datetime", "date time", "date/time", "date_time", "read date and end time",
        "read date", "timestamp", "interval end time", "interval end", "end time",
        "period end", "period", "time", "date", "billing date", "bill date",
        "usage date", "meter read date", "reading date", "interval date",
        "start date", "start time", "date and time", "reading timestamp",
    ],
    "import_kwh": [
        "import_kwh", "import kwh", "import (kwh)", "active import",
        "active import interval (kwh)", "active import interval (kw)", "consumption",
        "consumption (kwh)", "usage", "usage (kwh)", "kwh", "units", "units consumed",
        "energy (kwh)", "grid import", "grid import (kwh)", "import", "total kwh",
        "total consumption", "total usage", "read value", "meter reading", "reading",
        "day units", "night units", "peak units", "electricity usage",
        "electricity consumed",
    ],
    "export_kwh": [
        "export_kwh", "export kwh", "export (kwh)", "active export",
        "active export interval (kwh)", "active export interval (kw)", "generation",
        "generation (kwh)", "solar export", "grid export", "grid export (kwh)",
        "export", "feed-in", "feed in", "exported", "solar generation", "pv export",
    ],
    "mprn": [
        "mprn", "meter point reference", "meter point ref", "meter reference",
        "meter ref", "meter number", "meter point reference number", "mpan",
        "supply number", "account number", "meter id", "meter serial number", "gprn",
    ],
    "cost": [
        "cost", "cost (eur)", "cost (€)", "amount", "charge", "total cost",
        "total charge", "total amount", "net amount", "gross amount", "bill amount",
        "energy cost", "energy charge", "unit cost", "standing charge", "price",
        "value (€)", "value (eur)", "euro", "eur",
    ],
}
FIELD_ORDER = list(KNOWN_COLUMNS)

# Granularity codes.
HALF_HOURLY, HOURLY, DAILY, MONTHLY, UNKNOWN = "30min", "1h", "daily", "monthly", "unknown"
INTERVAL_CODES = [HALF_HOURLY, HOURLY]
DAILY_OR_FINER = [HALF_HOURLY, HOURLY, DAILY]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]

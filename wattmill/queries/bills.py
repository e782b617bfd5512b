"""Bill metrics, comparison, pro-ration and fuel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.constants import FUEL_FACTORS, UNIT_LABELS
from wattmill.operators import bills as bl
from wattmill.operators import filters, fuel
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import BILLS_SQL, bills, table

BY = ["client_id"]


def compared(spark, sf):
    return bl.comparison_rows(bills(spark, sf), keep=BY)


METRICS = ("bill_idx, filename, client_id, supplier, mprn, bill_date, sort_date, period_start, period_end, billing_days, "
           "total_kwh, day_kwh, night_kwh, peak_kwh, day_rate, night_rate, peak_rate, standing_charge, "
           "standing_charge_rate, subtotal, vat, total_cost, amount_due, confidence, cost_per_day, kwh_per_day, "
           "effective_rate, annualised_cost")
DOUBLES = ("total_kwh, day_kwh, night_kwh, peak_kwh, day_rate, night_rate, peak_rate, standing_charge, "
           "standing_charge_rate, subtotal, vat, total_cost, amount_due, confidence, cost_per_day, kwh_per_day, "
           "effective_rate, annualised_cost")


@query("bill_dates", f"WITH {BILLS_SQL} SELECT bill_idx, period_start, period_end, billing_days::INTEGER AS billing_days, parsed_bill_date FROM rows")
def bill_dates(spark, sf):
    return compared(spark, sf).select("bill_idx", "period_start", "period_end", "billing_days", "parsed_bill_date")


@query("bill_metrics", rounded_sql(f"SELECT {METRICS} FROM (SELECT * REPLACE (billing_days::INTEGER AS billing_days) FROM compared)", DOUBLES, BILLS_SQL))
def bill_metrics(spark, sf):
    return compared(spark, sf).select([c.strip() for c in METRICS.split(",")])


@query(
    "bill_edits",
    rounded_sql(
        """SELECT bill_idx, CASE WHEN bill_idx % 10 = 3 THEN 'Pinergy' ELSE supplier END AS supplier,
           CASE WHEN bill_idx % 10 = 7 THEN 123.45 ELSE total_cost END AS total_cost,
           CASE WHEN bill_idx % 10 = 7 THEN 123.45 ELSE nullif(total_cost, 0) END / billing_days AS cost_per_day
           FROM compared""",
        "total_cost, cost_per_day", BILLS_SQL),
)
def bill_edits(spark, sf):
    source = bills(spark, sf)
    digit = F.col("bill_idx") % 10
    edits = source.filter(digit.isin(3, 7)).select(
        "bill_idx", F.when(digit == 3, "supplier").otherwise("total_this_period").alias("field_name"),
        F.when(digit == 3, "Pinergy").otherwise("123.45").alias("value"),
    )
    return bl.comparison_rows(bl.overlay_edits(source, edits)).select(
        "bill_idx", "supplier", "total_cost", "cost_per_day")


LABELS_SQL = """
labelled AS (
  SELECT *, coalesce(strftime(period_start, '%b %Y'), strftime(parsed_bill_date, '%b %Y'), nullif(substr(bill_date, 1, 10), ''),
                     substr(filename, 1, 20)) AS short FROM compared)"""


@query(
    "bill_labels",
    f"""WITH {BILLS_SQL},{LABELS_SQL}
        SELECT bill_idx, client_id, CASE WHEN count(*) OVER (PARTITION BY client_id, short) > 1 THEN short || ' (' ||
          row_number() OVER (PARTITION BY client_id, short ORDER BY sort_date NULLS LAST, bill_idx) || ')'
          ELSE short END AS label FROM labelled""",
)
def bill_labels(spark, sf):
    return bl.with_labels(compared(spark, sf), BY).select("bill_idx", "client_id", "label")


@query(
    "bill_labels_one_set",
    f"""WITH {BILLS_SQL},{LABELS_SQL}
        SELECT bill_idx, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN short || ' (' ||
          row_number() OVER (PARTITION BY short ORDER BY sort_date NULLS LAST, bill_idx) || ')'
          ELSE short END AS label FROM labelled""",
)
def bill_labels_one_set(spark, sf):
    """All bills as one comparison set: a month's label is then shared by very many bills."""
    return bl.with_labels(compared(spark, sf)).select("bill_idx", "label")


SUMMARY = """count(*) AS bills, coalesce(sum(total_cost), 0.0) AS total_cost, count(total_cost) AS bills_with_cost,
  coalesce(sum(total_kwh), 0.0) AS total_kwh, count(total_kwh) AS bills_with_kwh,
  CASE WHEN sum(total_kwh) > 0 AND sum(total_cost) > 0 THEN sum(total_cost) / sum(total_kwh) END AS blended_rate,
  avg(annualised_cost) AS avg_annualised_cost, avg(cost_per_day) AS avg_cost_per_day,
  avg(kwh_per_day) AS avg_kwh_per_day, avg(total_cost) AS avg_cost_per_bill, sum(billing_days)::BIGINT AS days_covered,
  count(*) - count(total_cost) AS bills_without_cost"""
SUMMARY_DOUBLES = ("total_cost, total_kwh, blended_rate, avg_annualised_cost, avg_cost_per_day, avg_kwh_per_day, "
                   "avg_cost_per_bill")


@query("bill_summary", rounded_sql(f"SELECT client_id, {SUMMARY} FROM compared GROUP BY client_id", SUMMARY_DOUBLES, BILLS_SQL))
def bill_summary(spark, sf):
    return bl.summary_metrics(compared(spark, sf), BY)


SEGMENTS_SQL = """
segments AS (
  SELECT *, greatest(0, date_diff('day', greatest(month, period_start), least(month + INTERVAL 1 MONTH, period_end))) AS days
  FROM (SELECT *, unnest(generate_series(date_trunc('month', period_start)::TIMESTAMP,
                                         date_trunc('month', period_end - 1)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month
        FROM compared WHERE period_end > period_start))"""


@query("bill_prorate_segments", f"WITH {BILLS_SQL},{SEGMENTS_SQL} SELECT bill_idx, month, days::INTEGER AS days FROM segments")
def bill_prorate_segments(spark, sf):
    return bl.month_segments(compared(spark, sf)).select("bill_idx", "month", "days")


PRORATED = ", ".join(f"sum({c} * days / (period_end - period_start)) AS {c}" for c in bl.PRORATED)


@query(
    "bill_monthly",
    rounded_sql(
        f"""SELECT client_id, month, strftime(month, '%b %Y') AS month_label, {", ".join(bl.PRORATED)}, days_covered,
            total_cost / days_covered AS cost_per_day, total_kwh / days_covered AS kwh_per_day
            FROM (SELECT client_id, month, {PRORATED}, sum(days)::BIGINT AS days_covered FROM segments
                  GROUP BY client_id, month)""",
        ", ".join([*bl.PRORATED, "cost_per_day", "kwh_per_day"]), f"{BILLS_SQL},{SEGMENTS_SQL}", digits=9),
    digits=9,
)
def bill_monthly(spark, sf):
    return bl.monthly_prorated(compared(spark, sf), BY)


def _ends_sql(column: str, order: str, keys: str, source: str) -> str:
    return f"""SELECT {keys}, f AS first_value, l AS last_value, n AS values, l - f AS change,
  CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0.0 END AS change_pct
FROM (SELECT {keys}, (array_agg({column} ORDER BY {order}))[1] AS f, (array_agg({column} ORDER BY {order}))[-1] AS l,
             count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {keys}) WHERE n >= 2"""


CHANGE_DOUBLES = "first_value, last_value, change, change_pct"


@query("bill_trend_change", rounded_sql(_ends_sql("total_cost", "sort_date NULLS LAST, bill_idx", "client_id", "compared"), CHANGE_DOUBLES, BILLS_SQL))
def bill_trend_change(spark, sf):
    return bl.first_to_last(compared(spark, sf), "total_cost", ["sort_date", "bill_idx"], BY)


@query(
    "bill_monthly_change",
    rounded_sql(
        _ends_sql("kwh_per_day", "month", "client_id",
                  "(SELECT client_id, month, sum(total_kwh * days / (period_end - period_start)) / sum(days) AS kwh_per_day "
                  "FROM segments GROUP BY 1, 2)"),
        CHANGE_DOUBLES, f"{BILLS_SQL},{SEGMENTS_SQL}"),
)
def bill_monthly_change(spark, sf):
    return bl.first_to_last(bl.monthly_prorated(compared(spark, sf), BY), "kwh_per_day", ["month"], BY)


@query(
    "rate_changes",
    rounded_sql(
        _ends_sql("rate", "sort_date NULLS LAST, bill_idx", "client_id, tariff_no, tariff", "(" + " UNION ALL ".join(
            f"SELECT client_id, sort_date, bill_idx, {i}::INTEGER AS tariff_no, '{label}' AS tariff, {c} AS rate FROM compared"
            for i, (label, c) in enumerate(bl.RATE_LABELS)) + ")"),
        CHANGE_DOUBLES, BILLS_SQL),
)
def rate_changes(spark, sf):
    return bl.rate_changes(compared(spark, sf), BY)


@query(
    "bill_totals_row",
    rounded_sql(
        "SELECT client_id, filename, " + ", ".join([*bl.SUMMED, *bl.AVERAGED]).replace("billing_days", "billing_days::BIGINT AS billing_days")
        + " FROM compared UNION ALL SELECT client_id, 'TOTAL / AVG', "
        + ", ".join(f"sum({c})::BIGINT" if c == "billing_days" else f"sum({c})" for c in bl.SUMMED) + ", "
        + ", ".join(f"avg({c})" for c in bl.AVERAGED) + " FROM compared GROUP BY client_id",
        ", ".join(c for c in [*bl.SUMMED, *bl.AVERAGED] if c != "billing_days"), BILLS_SQL),
)
def bill_totals_row(spark, sf):
    return bl.with_totals(compared(spark, sf), BY)


@query(
    "tariff_split",
    f"""WITH {BILLS_SQL} SELECT client_id, bool_or(day_kwh IS NOT NULL) AS has_day_kwh, bool_or(night_kwh IS NOT NULL) AS has_night_kwh,
        bool_or(peak_kwh IS NOT NULL) AS has_peak_kwh FROM compared GROUP BY client_id""",
)
def tariff_split(spark, sf):
    return bl.has_tariff_split(compared(spark, sf), BY)


@query(
    "confidence_band",
    f"""WITH {BILLS_SQL} SELECT bill_idx, CASE WHEN bill_idx % 100 >= 80 THEN 'high' WHEN bill_idx % 100 >= 60 THEN 'partial'
        ELSE 'low' END AS band FROM compared""",
)
def confidence_band(spark, sf):
    return bills(spark, sf).select("bill_idx", bl.confidence_band(F.col("confidence_score")).alias("band"))


def _known_sql(columns: list[str]) -> str:
    return "(" + " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in columns) + ")"


@query(
    "field_coverage",
    f"""WITH {BILLS_SQL},
raw AS (SELECT *, nullif(bill_date, '') AS b, CASE WHEN bill_idx % 11 = 0 AND bill_idx % 2 = 1 THEN NULL ELSE mprn END AS m FROM rows)
SELECT bill_idx, 1 + {_known_sql(['m'])} AS account_fields, {_known_sql(['b', 'period_start'])} + 1 AS billing_fields,
       {_known_sql(['day_kwh', 'night_kwh', 'peak_kwh', 'total_kwh'])} AS consumption_fields,
       {_known_sql(['subtotal', 'vat', 'total_cost'])} + 1 AS costs_fields, {_known_sql(['amount_due'])} AS balance_fields,
       25::INTEGER AS section_expected FROM raw""",
)
def field_coverage(spark, sf):
    return bl.field_coverage(bills(spark, sf)).drop("field_count", "section_fields")


# ---------------------------------------------------------------- filters on bills


@query(
    "filter_mprn_blank",
    f"""WITH {BILLS_SQL}, pick AS (SELECT '10' || lpad(CAST(max(client_id) * 3 AS VARCHAR), 9, '0') AS m FROM rows)
        SELECT bill_idx, mprn FROM rows WHERE trim(mprn) = '' OR mprn IN ('10000000003', '10000000006')""",
)
def filter_mprn_blank(spark, sf):
    kept = filters.by_mprn(compared(spark, sf), ["10000000003", "10000000006", filters.NO_MPRN_LABEL])
    return kept.select("bill_idx", "mprn")


@query(
    "bill_filter_12m",
    f"""WITH {BILLS_SQL} SELECT bill_idx, sort_date FROM compared JOIN (SELECT client_id, max(sort_date) AS l FROM compared GROUP BY 1)
        USING (client_id) WHERE sort_date IS NULL OR sort_date >= l - 364""",
)
def bill_filter_12m(spark, sf):
    return filters.bills_by_period(compared(spark, sf), "12m", by=BY).select("bill_idx", "sort_date")


@query(
    "bill_filter_6m_one_set",
    f"""WITH {BILLS_SQL} SELECT bill_idx, sort_date FROM compared
        WHERE sort_date IS NULL OR sort_date >= (SELECT max(sort_date) FROM compared) - 182""",
)
def bill_filter_6m_one_set(spark, sf):
    return filters.bills_by_period(compared(spark, sf), "6m").select("bill_idx", "sort_date")


@query(
    "bill_presets",
    f"""WITH {BILLS_SQL} SELECT client_id, span::INTEGER AS span_days, CASE WHEN span >= 365 THEN '12m,6m' WHEN span >= 182 THEN '6m' ELSE '' END AS presets
        FROM (SELECT client_id, max(sort_date) - min(sort_date) AS span FROM compared GROUP BY client_id)""",
)
def bill_presets(spark, sf):
    offers = filters.available_presets(compared(spark, sf), BY)
    return offers.withColumn("presets", F.array_join("presets", ","))


@query(
    "bill_inclusion",
    f"WITH {BILLS_SQL} SELECT bill_idx, status FROM rows WHERE status <> 'error' AND client_id % 2 = 0",
)
def bill_inclusion(spark, sf):
    source = bills(spark, sf)
    ticked = source.filter("client_id % 2 = 0").select("filename")
    return filters.usable_bills(source, ticked).select("bill_idx", "status")


# ---------------------------------------------------------------- fuel purchases

FUELS = list(dict.fromkeys(f[0] for f in FUEL_FACTORS)) + ["turf"]
UNITS = [u for u, _ in UNIT_LABELS]


def _purchases(spark, sf):
    """One purchase per line item; some have a wrong unit, an unknown fuel or a zero amount."""
    part, line = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        (line * 8 + F.col("l_linenumber")).alias("purchase_id"),
        F.get(F.array(*[F.lit(f) for f in FUELS]), (part % len(FUELS)).cast("int")).alias("fuel_type"),
        F.get(F.array(*[F.lit(u) for u in UNITS]), (line % len(UNITS)).cast("int")).alias("unit"),
        F.when(part % 37 == 0, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("cost"),
        F.col("l_shipdate").cast("date").alias("purchase_date"),
        F.lit(None).cast("date").alias("period_end"),
        F.when(line % 3 == 0, " Coal Yard ").when(line % 3 == 1, " ").alias("supplier"),
    )


_FUEL_VALUES = ", ".join(f"('{f}', '{n}', '{u}', {k})" for f, n, u, k, _ in FUEL_FACTORS)
_FUEL_LIST = "[" + ", ".join(f"'{f}'" for f in FUELS) + "]"
_UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"
FUEL_SQL = f"""
p AS (
  SELECT l_orderkey * 8 + l_linenumber AS purchase_id, {_FUEL_LIST}[l_partkey % {len(FUELS)} + 1] AS fuel_type,
         {_UNIT_LIST}[l_orderkey % {len(UNITS)} + 1] AS unit, CASE WHEN l_partkey % 37 = 0 THEN 0.0 ELSE l_quantity END::DOUBLE AS quantity,
         l_extendedprice AS cost, l_orderkey AS k FROM lineitem),
f AS (SELECT * FROM (VALUES {_FUEL_VALUES}) v(fuel_type, display_name, unit, factor)),
names AS (SELECT DISTINCT fuel_type, display_name FROM f)"""


@query(
    "fuel_kwh",
    rounded_sql(
        """SELECT purchase_id, p.fuel_type, p.unit, quantity, (quantity * factor)::DOUBLE AS kwh, names.display_name,
           CASE WHEN names.fuel_type IS NULL THEN 'unknown fuel' WHEN factor IS NULL THEN 'invalid unit' END AS problem
           FROM p LEFT JOIN f USING (fuel_type, unit) LEFT JOIN names ON names.fuel_type = p.fuel_type""",
        "quantity, kwh", FUEL_SQL),
)
def fuel_kwh(spark, sf):
    out = fuel.convert_to_kwh(_purchases(spark, sf))
    problem = F.when(F.col("error").startswith("Unknown"), "unknown fuel").when(F.col("error").isNotNull(), "invalid unit")
    return out.select("purchase_id", "fuel_type", "unit", "quantity", "kwh", "display_name", problem.alias("problem"))


@query(
    "fuel_bills",
    rounded_sql(
        """SELECT purchase_id, CASE WHEN k % 3 = 0 THEN 'Coal Yard' ELSE names.display_name END AS supplier,
           CASE WHEN ok THEN round(quantity * factor, 2) END::DOUBLE AS total_units_kwh, CASE WHEN ok THEN cost END AS total_this_period,
           CASE WHEN ok THEN 'manual' ELSE 'error' END AS status
           FROM (SELECT p.*, factor, factor IS NOT NULL AND quantity > 0 AND cost > 0 AS ok FROM p LEFT JOIN f USING (fuel_type, unit)) x
           LEFT JOIN names ON names.fuel_type = x.fuel_type""",
        "total_units_kwh, total_this_period", FUEL_SQL),
)
def fuel_bills(spark, sf):
    out = fuel.purchases_to_bills(_purchases(spark, sf))
    return out.select("purchase_id", "supplier", "total_units_kwh", "total_this_period", "status")


# ---------------------------------------------------------------- nested bills

ITEMS = [("Day Energy", "A"), ("Night Energy", "N"), ("Standing Charge 61 days", "R")]


def generic_bills(spark, sf):
    """Nested bills with one line item per order line."""
    item = F.struct(
        F.when(F.col("l_returnflag") == "A", "Day Energy").when(F.col("l_returnflag") == "N", "Night Units")
        .otherwise("Standing Charge").alias("description"),
        F.col("l_extendedprice").alias("line_total"), F.col("l_quantity").alias("quantity"), F.lit("kWh").alias("unit"),
        F.col("l_tax").alias("unit_price"), F.lit(None).cast("double").alias("vat_rate"),
        F.lit(None).cast("double").alias("vat_amount"),
    )
    # An order has a handful of lines.
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("bill_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("item")))), lambda x: x["item"])
        .alias("line_items")
    )
    none = F.lit(None).cast("string")
    day = F.col("o_orderdate")
    period = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" - 31/12/2001"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" to 31 Dec 2001"))
    ).otherwise(F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit("-31.12.2001")))
    return table(spark, sf, "orders").withColumnRenamed("o_orderkey", "bill_id").join(items, "bill_id").select(
        "bill_id", F.lit("Energia").alias("provider"), none.alias("invoice_number"), none.alias("account_number"),
        none.alias("mprn"), none.alias("gprn"), F.date_format(day, "dd/MM/yyyy").alias("invoice_date"),
        F.expr("1").alias("x"), "line_items", day.alias("day"), F.col("o_totalprice").alias("total_incl_vat"),
    ).drop("x").withColumn("o_orderkey", F.col("bill_id")).withColumn("o_orderdate", F.col("day")).select(
        "bill_id", "provider", "invoice_number", "account_number", "mprn", "gprn", "invoice_date",
        period.alias("billing_period"), none.alias("due_date"), "line_items",
        F.lit(None).cast("double").alias("subtotal"), F.lit(None).cast("double").alias("vat_amount"),
        F.lit(9.0).alias("vat_rate"), "total_incl_vat", none.alias("fuel_type"),
        F.lit("tier2").alias("extraction_method"), F.lit(0.5).alias("confidence_score"), none.alias("raw_text"),
        F.array(F.lit("check")).alias("warnings"),
    )


@query(
    "generic_to_flat",
    rounded_sql(
        """
WITH items AS (
  SELECT l_orderkey AS bill_id, l_returnflag AS f, l_quantity AS q, l_tax AS r, l_extendedprice AS c,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag
                            ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem),
flat AS (
  SELECT bill_id, max(q) FILTER (WHERE f = 'A') AS day_units_kwh, max(r) FILTER (WHERE f = 'A') AS day_rate,
         max(c) FILTER (WHERE f = 'A') AS day_cost, max(q) FILTER (WHERE f = 'N') AS night_units_kwh,
         max(c) FILTER (WHERE f = 'N') AS night_cost, max(c) FILTER (WHERE f = 'R') AS standing_charge_total,
         CAST(max(q) FILTER (WHERE f = 'R') AS INTEGER) AS standing_charge_days
  FROM items WHERE rn = 1 GROUP BY bill_id)
SELECT bill_id, 'Energia' AS supplier, CASE bill_id % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y')
       ELSE strftime(o_orderdate, '%d.%m.%Y') END AS billing_period_start,
       CASE bill_id % 3 WHEN 0 THEN '31/12/2001' WHEN 1 THEN '31 Dec 2001' ELSE '31.12.2001' END AS billing_period_end,
       day_units_kwh, day_rate, day_cost, night_units_kwh, night_cost,
       CASE WHEN coalesce(day_units_kwh, night_units_kwh) IS NOT NULL THEN coalesce(day_units_kwh, 0) + coalesce(night_units_kwh, 0) END AS total_units_kwh,
       standing_charge_total, standing_charge_days, o_totalprice AS total_this_period
FROM flat JOIN orders ON o_orderkey = bill_id""",
        "day_units_kwh, day_rate, day_cost, night_units_kwh, night_cost, total_units_kwh, standing_charge_total, total_this_period"),
)
def generic_to_flat(spark, sf):
    flat = bl.flatten_bills(bl.bills_from_json(bl.bills_to_json(generic_bills(spark, sf))))
    return flat.select("bill_id", "supplier", "billing_period_start", "billing_period_end", "day_units_kwh", "day_rate",
                       "day_cost", "night_units_kwh", "night_cost", "total_units_kwh", "standing_charge_total",
                       "standing_charge_days", "total_this_period")

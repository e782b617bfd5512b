"""Energy-domain views derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.functions.steps import staged
from wattmill.operators.readings import with_features


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt_orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """o_orderkey and columns of orders, dealt by key: for texts and cells that cost far more than their rows.

    A table of few row groups is read by few tasks; and what is made of an order by key need not move again.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "orders").select("o_orderkey", *columns).repartition(parts, "o_orderkey")


# ---------------------------------------------------------------- half-hourly readings from events
# A meter is five users; `u` shapes its load so that every rule has meters on both sides of it.


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """(mprn, datetime, import_kwh, export_kwh) plus calendar features; about half the slots exist."""
    ts = F.col("ts")
    slot = F.date_trunc("hour", ts).cast("timestamp_ntz") + F.when(
        F.minute(ts) >= 30, F.expr("INTERVAL 30 MINUTES")
    ).otherwise(F.expr("INTERVAL 0 MINUTES"))
    exported = F.col("event_type") == "view"
    kwh = F.col("value") / 100
    slots = (
        table(spark, sf, "events")
        .select(F.expr("user_id div 5").alias("meter"), slot.alias("datetime"), exported.alias("out"), kwh.alias("kwh"))
        .groupBy("meter", "datetime")
        .agg(
            F.coalesce(F.sum(F.when(~F.col("out"), F.col("kwh"))), F.lit(0.0)).alias("i"),
            F.coalesce(F.sum(F.when(F.col("out"), F.col("kwh"))), F.lit(0.0)).alias("e"),
        )
    )
    u, hour = F.col("meter") % 10, F.hour("datetime")
    weekend = F.weekday(F.col("datetime").cast("date")) >= 5
    late_step = (u % 4 == 0) & (F.col("datetime") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    shaped = slots.select(
        F.concat(F.lit("10"), F.lpad(F.col("meter").cast("string"), 9, "0")).alias("mprn"),
        "datetime",
        F.round(
            F.col("i") * F.when((u % 2 == 1) & hour.isin(17, 18), 3.0).otherwise(1.0)
            * F.when((u % 3 == 0) & weekend, 1.6).otherwise(1.0)
            + u * 0.05 + F.when(late_step, 0.2).otherwise(0.0), 6,
        ).alias("import_kwh"),
        F.round(F.col("e") * F.when((u % 5 == 0) & hour.between(8, 17), 8.0).otherwise(1.0), 6).alias("export_kwh"),
    )
    return with_features(shaped)


FEATURES_SQL = """
  hour(datetime) AS hour, CAST(datetime AS DATE) AS date, isodow(datetime) - 1 AS day_of_week_num,
  dayname(datetime) AS day_of_week, isodow(datetime) >= 6 AS is_weekend, monthname(datetime) AS month,
  strftime(datetime, '%Y-%m') AS year_month,
  CASE WHEN hour(datetime) >= 23 OR hour(datetime) < 8 THEN 'Night'
       WHEN hour(datetime) IN (17, 18) THEN 'Peak' ELSE 'Day' END AS tariff_period
"""

READINGS_SQL = f"""
slots AS (
  SELECT user_id // 5 AS meter, time_bucket(INTERVAL '30 minutes', ts) AS datetime,
         coalesce(sum(value / 100) FILTER (WHERE event_type <> 'view'), 0.0) AS i,
         coalesce(sum(value / 100) FILTER (WHERE event_type = 'view'), 0.0) AS e
  FROM events GROUP BY 1, 2),
shaped AS (
  SELECT '10' || lpad(CAST(meter AS VARCHAR), 9, '0') AS mprn, datetime,
         round(i * (CASE WHEN meter % 2 = 1 AND hour(datetime) IN (17, 18) THEN 3.0 ELSE 1.0 END)
               * (CASE WHEN meter % 10 % 3 = 0 AND isodow(datetime) >= 6 THEN 1.6 ELSE 1.0 END)
               + (meter % 10) * 0.05
               + (CASE WHEN meter % 10 % 4 = 0 AND datetime >= TIMESTAMP '2024-01-16' THEN 0.2 ELSE 0.0 END), 6)
           ::DOUBLE AS import_kwh,
         round(e * (CASE WHEN meter % 5 = 0 AND hour(datetime) BETWEEN 8 AND 17 THEN 8.0 ELSE 1.0 END), 6)
           ::DOUBLE AS export_kwh
  FROM slots),
readings AS (SELECT *, {FEATURES_SQL} FROM shaped)"""


# ---------------------------------------------------------------- daily series from orders


def daily_readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per meter and order date over six and a half years; a meter is 25 customers."""
    rows = (
        table(spark, sf, "orders")
        .groupBy(F.expr("o_custkey div 25").alias("meter"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"))
        .agg((F.sum("o_totalprice") / 10000).alias("import_kwh"))
        .select(
            F.concat(F.lit("10"), F.lpad(F.col("meter").cast("string"), 9, "0")).alias("mprn"), "datetime",
            F.round("import_kwh", 6).alias("import_kwh"), F.lit(0.0).alias("export_kwh"),
        )
    )
    return with_features(rows)


DAILY_READINGS_SQL = f"""
readings AS (
  SELECT *, {FEATURES_SQL} FROM (
    SELECT '10' || lpad(CAST(o_custkey // 25 AS VARCHAR), 9, '0') AS mprn, o_orderdate AS datetime,
           round(sum(o_totalprice) / 10000, 6) AS import_kwh, 0.0::DOUBLE AS export_kwh
    FROM orders GROUP BY o_custkey // 25, o_orderdate))"""


# ---------------------------------------------------------------- client spreadsheets from orders
# One file per hundred customers, in three layouts: known headers, similar headers, headers that say nothing.

SHEET_HEADERS = {
    0: ["Date/Time", "Usage (kWh)", "Export", "MPRN", "Cost (€)"],
    1: ["Reading Date Time", "Units Consumed kWh", "Meter Ref No", "Total Cost EUR"],
    2: ["Col A", "Col B", "Col C", "Col D", "Col E"],
}


def sheets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of messy files: mixed date formats, currency signs, blanks, negatives, repeats."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") / 10).cast("bigint")
    day = F.col("o_orderdate")
    date_text = (
        F.when(key % 23 == 0, F.lit(None))
        .when(key % 19 == 0, "n.a.")
        .when(key % 17 == 0, F.date_format(day, "MM/dd/yyyy"))
        .when(key % 3 == 0, F.concat(F.date_format(day, "dd-MM-yyyy "), F.lpad((key % 24).cast("string"), 2, "0"),
                                     F.lit(":30")))
        .when(key % 3 == 1, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )
    whole, part = F.expr("c div 100"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    plain = F.concat(whole.cast("string"), F.lit("."), part)
    usage = (
        F.when(key % 46 == 0, F.lit(None))
        .when(key % 29 == 0, F.concat(F.lit("-"), plain))
        .when(key % 31 == 0, "err")
        .when(key % 7 == 0, F.concat(F.lit("€ 1,"), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit("."), part))
        .otherwise(plain)
    )
    mprn = F.concat(F.lit("10"), F.lpad(F.expr("o_custkey div 25").cast("string"), 9, "0"),
                    F.when(key % 5 == 0, "  ").otherwise(""))
    cost = F.concat(F.lit("€"), plain)
    orders = dealt_orders(spark, sf, "o_custkey", "o_totalprice", "o_orderdate")
    base = orders.withColumn("c", cents).withColumn("kind", F.expr("(o_custkey div 100) % 3"))
    base = base.withColumns({
        "d": date_text.cast("string"), "use": usage.cast("string"), "m": mprn, "cost": cost,
        "export": F.when(key % 4 == 0, "0.5").cast("string"), "note": F.concat(F.lit("note "), key.cast("string")),
    })
    rows = base.select(
        F.concat(F.lit("sheet_"), F.expr("o_custkey div 100").cast("string")).alias("file_id"),
        key.alias("row_idx"),
        F.when(F.col("kind") == 0, F.array("d", "use", "export", "m", "cost"))
        .when(F.col("kind") == 1, F.array("d", "use", "m", "cost"))
        .otherwise(F.array("m", "d", "use", "note", "cost"))
        .alias("cells"),
    )
    names = [F.array(*[F.lit(h) for h in SHEET_HEADERS[k]]) for k in (0, 1, 2)]
    files = base.groupBy(F.expr("o_custkey div 100").alias("n")).agg(F.first("kind").alias("kind"))
    headers = files.select(
        F.concat(F.lit("sheet_"), F.col("n").cast("string")).alias("file_id"),
        F.posexplode(F.when(F.col("kind") == 0, names[0]).when(F.col("kind") == 1, names[1]).otherwise(names[2]))
        .alias("col_idx", "column_name"),
    )
    return rows, headers


SHEET_CELLS_SQL = """
raw AS (
  SELECT 'sheet_' || (o_custkey // 100) AS file_id, o_orderkey AS row_idx, (o_custkey // 100) % 3 AS kind,
         o_orderkey AS key, CAST(round(o_totalprice / 10) AS BIGINT) AS c, o_orderdate AS day, o_custkey FROM orders),
texts AS (
  SELECT file_id, row_idx, kind, key, c,
         CASE WHEN key % 23 = 0 THEN NULL WHEN key % 19 = 0 THEN 'n.a.'
              WHEN key % 17 = 0 THEN strftime(day, '%m/%d/%Y')
              WHEN key % 3 = 0 THEN strftime(day, '%d-%m-%Y ') || lpad(CAST(key % 24 AS VARCHAR), 2, '0') || ':30'
              WHEN key % 3 = 1 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%Y-%m-%d %H:%M:%S') END AS d,
         CASE WHEN key % 46 = 0 THEN NULL WHEN key % 29 = 0 THEN '-' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
              WHEN key % 31 = 0 THEN 'err'
              WHEN key % 7 = 0 THEN '€ 1,' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
              ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS use,
         '10' || lpad(CAST(o_custkey // 25 AS VARCHAR), 9, '0') || CASE WHEN key % 5 = 0 THEN '  ' ELSE '' END AS m,
         CASE WHEN key % 4 = 0 THEN '0.5' END AS ex,
         '€' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS cost
  FROM raw)"""

SHEET_PARSED_SQL = SHEET_CELLS_SQL + """,
parsed AS (
  SELECT file_id, row_idx, kind, d IS NULL AND use IS NULL AS is_empty, d, trim(m) AS mprn,
         coalesce(day_first, month_first) AS datetime, day_first IS NULL AND month_first IS NOT NULL AS swapped, raw,
         CASE WHEN kind = 0 THEN abs(raw) ELSE CASE WHEN raw < 0 THEN 0.0 ELSE raw END END AS import_kwh,
         CASE WHEN kind = 0 THEN TRY_CAST(ex AS DOUBLE)
              ELSE coalesce(CASE WHEN raw < 0 THEN -raw ELSE CASE WHEN raw IS NULL THEN NULL ELSE 0.0 END END, 0.0) END AS export_kwh,
         TRY_CAST(regexp_replace(cost, '[€$£,\\s]', '', 'g') AS DOUBLE) AS cost
  FROM (SELECT *, coalesce(try_strptime(d, '%Y-%m-%d %H:%M:%S'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d-%m-%Y %H:%M')) AS day_first,
               try_strptime(d, '%m/%d/%Y') AS month_first,
               TRY_CAST(regexp_replace(use, '[€$£,\\s]', '', 'g') AS DOUBLE) AS raw FROM texts)),
clean AS (
  SELECT file_id, mprn, datetime, import_kwh, export_kwh, cost FROM parsed WHERE NOT is_empty AND datetime IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id, mprn, datetime ORDER BY row_idx) = 1)"""


# ---------------------------------------------------------------- bills from orders and lineitem


def bills(spark: SparkSession, sf: str) -> DataFrame:
    """Flat bills, one per order; a client is a customer.  Dates come as text in four layouts."""
    units = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(n)
          for f, n in (("A", "day_units_kwh"), ("N", "night_units_kwh"), ("R", "peak_units_kwh"))]
    )
    key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 71 + 20).cast("int"))

    def as_text(day):
        return (
            F.when(key % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 4 == 1, F.date_format(day, "d MMM yyyy"))
            .when(key % 4 == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yy"))
        )

    cost = F.when(key % 17 == 0, F.lit(None)).when(key % 43 == 0, 0.0).otherwise(F.floor(F.col("o_totalprice") / 10) / 100)
    split = ["day_units_kwh", "night_units_kwh", "peak_units_kwh"]
    total = F.when(F.coalesce(*split).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in split), F.lit(0.0)))
    suppliers = ["Electric Ireland", "Energia", "SSE Airtricity", "Bord Gais Energy", "Flogas", "Unlisted"]
    named = F.get(F.array(*[F.lit(s) for s in suppliers]), (key % 6).cast("int"))
    return table(spark, sf, "orders").join(units, "o_orderkey", "left").withColumn("c", cost).select(
        key.alias("bill_idx"),
        F.concat(F.lit("bill_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("o_custkey").alias("client_id"),
        F.when(key % 37 == 0, "error").when(key % 41 == 0, "manual").otherwise("success").alias("status"),
        F.when(key % 53 == 0, "").otherwise(named).alias("supplier"),
        F.when(key % 11 == 0, F.when(key % 2 == 0, "  ")).otherwise(
            F.concat(F.lit("10"), F.lpad((F.col("o_custkey") * 3 + key % 2).cast("string"), 9, "0"))).alias("mprn"),
        F.when(key % 5 != 0, as_text(F.date_add(end, 5))).alias("bill_date"),
        F.when(key % 13 != 0, as_text(start)).alias("billing_period_start"),
        F.when(key % 29 == 0, "TBC").otherwise(as_text(end)).alias("billing_period_end"),
        *split, total.alias("total_units_kwh"),
        (F.lit(0.25) + key % 10 / 100).alias("day_rate"), (F.lit(0.15) + key % 7 / 100).alias("night_rate"),
        F.when(key % 3 == 0, 0.35).alias("peak_rate"),
        (key % 50 + 10).cast("double").alias("standing_charge_total"),
        (F.lit(0.5) + key % 5 / 10).alias("standing_charge_rate"),
        F.round(F.col("c") / 1.09, 2).alias("subtotal_before_vat"),
        F.round(F.col("c") - F.round(F.col("c") / 1.09, 2), 2).alias("vat_amount"),
        F.col("c").alias("total_this_period"), F.col("c").alias("amount_due"),
        (key % 100 / 100).alias("confidence_score"),
        F.lit(None).cast("string").alias("fuel_type"),
    )


def _text_sql(day: str) -> str:
    return (f"CASE key % 4 WHEN 0 THEN strftime({day}, '%d/%m/%Y') WHEN 1 THEN strftime({day}, '%-d %b %Y') "
            f"WHEN 2 THEN strftime({day}, '%Y-%m-%d') ELSE strftime({day}, '%d.%m.%y') END")


BILLS_SQL = f"""
units AS (
  SELECT l_orderkey AS key, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS day_kwh,
         sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS night_kwh,
         sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS peak_kwh FROM lineitem GROUP BY 1),
base AS (
  SELECT o_orderkey AS key, o_custkey AS client_id, o_orderdate::DATE AS s,
         (o_orderdate::DATE + CAST(o_orderkey % 71 + 20 AS INTEGER)) AS e,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 0.0
              ELSE floor(o_totalprice / 10) / 100 END::DOUBLE AS total_cost FROM orders),
rows AS (
  SELECT *, total_cost / nullif(nullif(total_cost, 0), NULL) AS one FROM (
  SELECT key AS bill_idx, 'bill_' || key || '.pdf' AS filename, client_id,
         CASE WHEN key % 37 = 0 THEN 'error' WHEN key % 41 = 0 THEN 'manual' ELSE 'success' END AS status,
         CASE WHEN key % 53 = 0 THEN 'Unknown' ELSE ['Electric Ireland', 'Energia', 'SSE Airtricity', 'Bord Gais Energy',
              'Flogas', 'Unlisted'][key % 6 + 1] END AS supplier,
         CASE WHEN key % 11 = 0 THEN CASE WHEN key % 2 = 0 THEN '  ' ELSE '' END
              ELSE '10' || lpad(CAST(client_id * 3 + key % 2 AS VARCHAR), 9, '0') END AS mprn,
         CASE WHEN key % 5 <> 0 THEN {_text_sql('e + 5')} ELSE '' END AS bill_date,
         CASE WHEN key % 5 <> 0 THEN e + 5 END AS parsed_bill_date,
         CASE WHEN key % 13 <> 0 THEN s END AS period_start, CASE WHEN key % 29 <> 0 THEN e END AS period_end,
         CASE WHEN key % 13 <> 0 AND key % 29 <> 0 THEN e - s END AS billing_days,
         coalesce(CASE WHEN key % 13 <> 0 THEN s END, CASE WHEN key % 5 <> 0 THEN e + 5 END) AS sort_date,
         day_kwh, night_kwh, peak_kwh,
         CASE WHEN coalesce(day_kwh, night_kwh, peak_kwh) IS NOT NULL
              THEN coalesce(day_kwh, 0) + coalesce(night_kwh, 0) + coalesce(peak_kwh, 0) END AS total_kwh,
         0.25::DOUBLE + key % 10 / 100 AS day_rate, 0.15::DOUBLE + key % 7 / 100 AS night_rate,
         CASE WHEN key % 3 = 0 THEN 0.35 END::DOUBLE AS peak_rate, (key % 50 + 10)::DOUBLE AS standing_charge,
         0.5::DOUBLE + key % 5 / 10 AS standing_charge_rate, round(total_cost / 1.09, 2)::DOUBLE AS subtotal,
         round(total_cost - round(total_cost / 1.09, 2), 2)::DOUBLE AS vat, total_cost, total_cost AS amount_due,
         (key % 100 / 100)::DOUBLE AS confidence
  FROM base LEFT JOIN units USING (key))),
compared AS (
  SELECT * EXCLUDE (one), nullif(total_cost, 0) / nullif(billing_days, 0) AS cost_per_day,
         nullif(total_kwh, 0) / nullif(billing_days, 0) AS kwh_per_day,
         nullif(total_cost, 0) / nullif(total_kwh, 0) AS effective_rate,
         nullif(total_cost, 0) / nullif(billing_days, 0) * 365 AS annualised_cost FROM rows)"""


# ---------------------------------------------------------------- bill texts from orders
# Seven layouts: six providers with rules of their own and one the engine does not know.

LAYOUTS = ["Energia", "Electric Ireland", "SSE Airtricity", "unknown", "Kerry Petroleum", "ESB Networks", "Go Power"]


def bill_values(spark: SparkSession, sf: str) -> DataFrame:
    """The true values behind each bill text, as printable strings."""
    key = F.col("o_orderkey")

    def euros(cents):
        return F.concat((F.floor(cents / 100)).cast("bigint").cast("string"), F.lit("."),
                        F.lpad((cents % 100).cast("string"), 2, "0"))

    def rate(units):
        return F.concat(F.lit("0."), F.lpad(units.cast("string"), 4, "0"))

    base = dealt_orders(spark, sf, "o_orderdate").select(
        key.alias("bill_id"), (key % 7).cast("int").alias("layout"),
        F.concat(F.lit("10"), F.lpad(key.cast("string"), 9, "0")).alias("mprn"),
        (F.lit(7000000) + key).cast("string").alias("account"),
        (key % 900 + 100).alias("dk"), (key % 300 + 50).alias("nk"),
        (key % 10 * 100 + 2500).alias("dr"), (key % 7 * 100 + 1500).alias("nr"),
        F.col("o_orderdate").cast("date").alias("start"),
        F.date_add(F.col("o_orderdate").cast("date"), 59).alias("end"),
        (key % 6 == 0).alias("bad_vat"), (key % 10 == 3).alias("no_total"), (key % 9 == 0).alias("scanned"),
    )
    steps = {
        "dc": "(dk * dr + 50) div 100", "nc": "(nk * nr + 50) div 100", "net": "dc + nc + 1650 + 201",
        "vat": "(net * 9 + 50) div 100", "printed_vat": "if(bad_vat, vat * 10 + 1, vat)",
    }
    for name, formula in steps.items():
        base = staged(base, {name: F.expr(formula)})
    return base.select(
        "bill_id", "layout", "mprn", "account", "dk", "nk", "start", "end", "bad_vat", "no_total", "scanned",
        rate(F.col("dr")).alias("dr"), rate(F.col("nr")).alias("nr"), euros(F.col("dc")).alias("dc"),
        euros(F.col("nc")).alias("nc"), euros(F.col("net")).alias("net"), euros(F.col("vat")).alias("vat"),
        euros(F.col("printed_vat")).alias("printed_vat"), euros(F.col("net") + F.col("vat")).alias("total"),
    )


# Lines of each layout; `?` marks a line that only bills with a printed total have.
LAYOUT_LINES = [
    ["Energia customer bill", "Account Number {account}", "MPRN: {mprn}", "Billing Period {s1} - {e1}",
     "Day Energy {dk} kWh @ €{dr} €{dc}", "Night Energy {nk} kWh @ €{nr} €{nc}",
     "Standing Charge 30 Days @ €0.55 €16.50", "PSO Levy €2.01", "Total Excluding VAT €{net}", "VAT 9% €{printed_vat}",
     "?Total Charges For the Period €{total}", "www.energia.ie"],
    ["Electric Ireland customer bill", "Account Number", "{account}", "MPRN {mprn}", "Billing Period", "{s1} - {e1}",
     "Day {dk}.5 Units at €{dr} per Unit", "€{dc}", "Night {nk}.25 Units at €{nr} per Unit", "€{nc}",
     "Standing Charge 30 days at €0.55 per day", "€16.50", "Public Service Obligation Levy - 2 months at €1.00", "€2.01",
     "Sub Total before VAT", "€{net}", "VAT on €{net} at 9%", "€{printed_vat}", "?Total transactions for this period",
     "?€{total}", "electricireland.ie"],
    ["SSE Airtricity customer bill", "Account Number: {account}", "MPRN {mprn}", "{s1} to {e1}", "SmartSaver Std Day",
     "{dk}.00", "{dr}", "SmartSaver Std Night", "{nk}.00", "{nr}", "Standing Charge P4 Dom Urban", "30.00", "0.5500",
     "16.50", "Total costs for this period {net}", "VAT 9%", "Total VAT {printed_vat}",
     "?Total charges for this period {total}", "sseairtricity.com"],
    ["Green Valley Utilities customer bill", "Account Number: {account}", "MPRN: {mprn}", "Billing Period: {s1} - {e1}",
     "Day Energy {dk} kWh @ €{dr}", "Night Energy {nk} kWh @ €{nr}", "Standing Charge for the period €16.50",
     "PSO Levy 2.01", "Sub Total €{net}", "VAT 9% €{printed_vat}", "?Total due €{total}"],
    ["Kerry Petroleum customer invoice", "INVOICE No. {ref}", "Date: {s1}",
     "Heating oil delivered to the customer address as ordered", "KEROSENE {dk} 0.95 {net} 13.50 {vat} {total}",
     "Thank you for your custom and please pay within thirty days"],
    ["ESB Networks customer bill", "MPRN {mprn}", "Billing period 29 Feb 24 to 30 Apr 24",
     "Standing Charge 16.50 30 days @ €0.5500 / day", "Standing Charge 17.05 31 days @ €0.5500 / day",
     "Total electricity charges {net}", "VAT {printed_vat} 9%", "?Total due €{total}",
     "Call ESB Networks for emergencies"],
    ["Go Power customer bill", "Account Code: {account}", "MPRN {mprn}", "Usage Period 1 Jan 24 to 31 Jan 24",
     "Energy {dk} kWh {cents} €{dc}", "Standing Charge 30 days €16.50", "PSO Levy €2.01", "Sub Total €{net}",
     "VAT @ 9% €{printed_vat}", "?NEW BALANCE DUE €{total}", "gopower.ie"],
]


def _pieces(template: str) -> list[tuple[str, bool]]:
    """(text, is it the name of a value) of a line."""
    return [(x, i % 2 == 1) for i, x in enumerate(template.replace("}", "{").split("{")) if x]


def bill_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(bill_id, layout, scanned, lines ARRAY<STRING>)."""
    v = bill_values(spark, sf).withColumns({
        "s1": F.date_format("start", "dd/MM/yyyy"), "e1": F.date_format("end", "dd/MM/yyyy"),
        "ref": F.lpad((F.col("bill_id") % 1000000).cast("string"), 6, "0"),
        "cents": F.format_string("%.2f", F.col("dr").cast("double") * 100),
    })

    def line(template: str):
        text = F.concat(*[F.col(x).cast("string") if named else F.lit(x) for x, named in _pieces(template.lstrip("?"))])
        return F.when(~F.col("no_total"), text) if template.startswith("?") else text

    layouts = [F.array(*[line(x) for x in lines]) for lines in LAYOUT_LINES]
    chosen = layouts[-1]
    for number, body in reversed(list(enumerate(layouts[:-1]))):
        chosen = F.when(F.col("layout") == number, body).otherwise(chosen)
    return v.select("bill_id", "layout", "scanned", F.filter(chosen, lambda x: x.isNotNull()).alias("lines"))


def bill_texts(spark: SparkSession, sf: str) -> DataFrame:
    return bill_lines(spark, sf).select("bill_id", F.array_join("lines", "\n").alias("text"))


def bill_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two pages per bill; scanned bills only carry scraps of text."""
    half = F.floor(F.size("lines") / 2).cast("int")
    pages = F.array(
        F.struct(F.lit(1).alias("page_no"), F.array_join(F.slice("lines", F.lit(1), half), "\n").alias("text")),
        F.struct(F.lit(2).alias("page_no"),
                 F.array_join(F.slice("lines", half + 1, F.size("lines") - half), "\n").alias("text")),
    )
    scraps = F.array(F.struct(F.lit(1).alias("page_no"), F.lit("Il lI 1l %% 12").alias("text")))
    return bill_lines(spark, sf).select("bill_id", F.inline(F.when(F.col("scanned"), scraps).otherwise(pages)))


def ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    """Word table of the scanned bills: one row per word, laid out by line and position."""
    lines = bill_lines(spark, sf).filter("scanned").select("bill_id", F.posexplode("lines").alias("line", "text"))
    words = lines.select("bill_id", "line", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return words.select(
        F.col("bill_id").alias("doc_id"), F.lit(1).alias("page_num"), F.lit(1).alias("block_num"),
        (F.col("line") + 1).alias("line_num"), (F.col("pos") + 1).alias("word_num"),
        (F.col("pos") * 80 + 10).alias("left"), (F.col("line") * 24 + 10).alias("top"), F.lit(60).alias("width"),
        F.lit(20).alias("height"),
        F.when((F.col("bill_id") + F.col("line") * 7 + F.col("pos")) % 97 == 0, -1)
        .otherwise(F.lit(90) - (F.col("line") + F.col("pos")) % 7).cast("double").alias("conf"),
        "text",
    )


BILL_VALUES_SQL = """
vals AS (
  SELECT bill_id, layout, mprn, account, dk, nk, s, e, bad_vat, no_total, scanned, dr / 10000 AS dr, nr / 10000 AS nr, dc / 100 AS dc,
         nc / 100 AS nc, net / 100 AS net, vat / 100 AS vat, (net + vat) / 100 AS total,
         CASE WHEN bad_vat THEN vat * 10 + 1 ELSE vat END / 100 AS printed_vat
  FROM (SELECT *, (net * 9 + 50) // 100 AS vat FROM (SELECT *, dc + nc + 1650 + 201 AS net FROM (
    SELECT *, (dk * dr + 50) // 100 AS dc, (nk * nr + 50) // 100 AS nc FROM (
      SELECT o_orderkey AS bill_id, o_orderkey % 7 AS layout, '10' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mprn,
             CAST(7000000 + o_orderkey AS VARCHAR) AS account, o_orderkey % 900 + 100 AS dk, o_orderkey % 300 + 50 AS nk,
             o_orderkey % 10 * 100 + 2500 AS dr, o_orderkey % 7 * 100 + 1500 AS nr, o_orderdate::DATE AS s,
             o_orderdate::DATE + 59 AS e, o_orderkey % 6 = 0 AS bad_vat, o_orderkey % 10 = 3 AS no_total,
             o_orderkey % 9 = 0 AS scanned FROM orders)))))"""


_SQL_TEXTS = {
    "s1": "strftime(s, '%d/%m/%Y')", "e1": "strftime(e, '%d/%m/%Y')", "cents": "printf('%.2f', dr * 100)",
    "ref": "lpad(CAST(bill_id % 1000000 AS VARCHAR), 6, '0')", "dr": "printf('%.4f', dr)", "nr": "printf('%.4f', nr)",
    **{x: f"printf('%.2f', {x})" for x in ("dc", "nc", "net", "vat", "printed_vat", "total")},
}


def _line_sql(template: str) -> str:
    text = " || ".join(_SQL_TEXTS.get(x, x) if named else f"'{x}'" for x, named in _pieces(template.lstrip("?")))
    return f"CASE WHEN NOT no_total THEN {text} END" if template.startswith("?") else f"'' || {text}"


_LAYOUTS_SQL = " ".join(f"WHEN {n} THEN [{', '.join(map(_line_sql, lines))}]" for n, lines in enumerate(LAYOUT_LINES))
BILL_LINES_SQL = BILL_VALUES_SQL + f""",
texts AS (SELECT *, list_filter(CASE layout {_LAYOUTS_SQL} END, lambda x: x IS NOT NULL) AS lines FROM vals)"""


# ---------------------------------------------------------------- bills to verify against the readings


def case_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with their case: a meter is one case."""
    return readings(spark, sf).withColumn("case_id", F.substring("mprn", 3, 9).cast("bigint"))


def verify_bills(spark: SparkSession, sf: str) -> DataFrame:
    """One bill per order, five users' worth of customers per case; some name another meter, some none."""
    key = F.col("o_orderkey")
    case = F.expr("o_custkey div 50")
    start = F.date_add(F.lit("2023-12-15").cast("date"), (key % 40).cast("int"))
    end = F.date_add(start, (key % 60 + 5).cast("int"))
    suppliers = F.array(*[F.lit(s) for s in ("Electric Ireland", "Energia", "Flogas", "Unlisted")])
    return table(spark, sf, "orders").select(
        key.alias("bill_idx"), case.alias("case_id"),
        F.get(suppliers, (key % 4).cast("int")).alias("supplier"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, "10999999999").otherwise(
            F.concat(F.lit(" 10"), F.lpad(case.cast("string"), 9, "0"))).alias("mprn"),
        F.when(key % 11 != 0, F.date_format(start, "dd/MM/yyyy")).alias("billing_period_start"),
        F.when(key % 13 == 0, F.date_format(start, "dd/MM/yyyy")).otherwise(F.date_format(end, "d MMM yyyy"))
        .alias("billing_period_end"),
        F.when(key % 22 == 0, start).alias("override_start"), F.lit(None).cast("date").alias("override_end"),
        (key % 50 + 20).cast("double").alias("day_units_kwh"), (key % 30 + 10).cast("double").alias("night_units_kwh"),
        F.lit(None).cast("double").alias("peak_units_kwh"),
        F.when(key % 5 != 0, (key % 100 + 30).cast("double")).alias("total_units_kwh"),
        F.lit(0.28).alias("day_rate"), F.lit(0.15).alias("night_rate"), F.when(key % 2 == 0, 0.3).alias("peak_rate"),
        (F.col("o_totalprice") / 10000).alias("total_this_period"),
        (key % 60 + 5 + F.when(key % 6 == 0, 2).otherwise(0)).cast("int").alias("standing_charge_days"),
        F.lit(20.0).alias("standing_charge_total"),
        F.lit(None).cast("double").alias("export_units"), F.when(key % 3 == 0, 4.0).alias("export_credit"),
    )


VERIFY_SQL = f"""{READINGS_SQL},
vb AS (
  SELECT o_orderkey AS bill_idx, o_custkey // 50 AS case_id, ['Electric Ireland', 'Energia', 'Flogas', 'Unlisted'][o_orderkey % 4 + 1] AS supplier,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '10999999999' ELSE '10' || lpad(CAST(o_custkey // 50 AS VARCHAR), 9, '0') END AS mprn,
         CASE WHEN o_orderkey % 11 <> 0 OR o_orderkey % 22 = 0 THEN s END AS bill_start, CASE WHEN o_orderkey % 13 = 0 THEN s ELSE e END AS bill_end,
         (o_orderkey % 50 + 20)::DOUBLE AS day_b, (o_orderkey % 30 + 10)::DOUBLE AS night_b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 + 30 END::DOUBLE AS total_b,
         CASE WHEN o_orderkey % 2 = 0 THEN 0.3 END::DOUBLE AS peak_rate, o_totalprice / 10000 AS cost,
         (o_orderkey % 60 + 5 + CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END)::INTEGER AS sdays, CASE WHEN o_orderkey % 3 = 0 THEN 4.0 END::DOUBLE AS credit
  FROM (SELECT *, DATE '2023-12-15' + CAST(o_orderkey % 40 AS INTEGER) AS s,
               DATE '2023-12-15' + CAST(o_orderkey % 40 + o_orderkey % 60 + 5 AS INTEGER) AS e FROM orders)),
hm AS (SELECT CAST(substr(mprn, 3, 9) AS BIGINT) AS case_id, min(mprn) AS hdf_mprn, min(date) AS hdf_start, max(date) AS hdf_end FROM readings GROUP BY 1),
v1 AS (
  SELECT *, coalesce(mprn IS NOT NULL AND hdf_mprn IS NOT NULL AND mprn <> hdf_mprn, false) AS mismatch, bill_start IS NULL OR bill_end IS NULL AS undated FROM vb LEFT JOIN hm USING (case_id)),
v2 AS (SELECT *, CASE WHEN NOT mismatch AND NOT undated AND hdf_start IS NOT NULL THEN bill_end - bill_start ELSE 0 END AS billing_days FROM v1),
v3 AS (
  SELECT *, CASE WHEN billing_days > 0 THEN greatest(0, least(bill_end, hdf_end) - greatest(bill_start, hdf_start)) ELSE 0 END AS overlap_days FROM v2),
checked AS (
  SELECT *, CASE WHEN billing_days <> 0 THEN overlap_days * 100.0 / billing_days ELSE 0 END::DOUBLE AS overlap_pct,
         CASE WHEN mismatch THEN 'meter mismatch' WHEN undated THEN 'no billing period' WHEN hdf_start IS NULL THEN 'no meter readings'
              WHEN billing_days <= 0 THEN 'period ends before it starts' WHEN overlap_days = 0 THEN 'no overlap' END AS block_reason FROM v3),
met AS (
  SELECT bill_idx, count(*) AS reads, sum(import_kwh) AS total, coalesce(sum(import_kwh) FILTER (WHERE tariff_period = 'Day'), 0) AS day,
         coalesce(sum(import_kwh) FILTER (WHERE tariff_period = 'Night'), 0) AS night, coalesce(sum(import_kwh) FILTER (WHERE tariff_period = 'Peak'), 0) AS peak, sum(export_kwh) AS export
  FROM checked c JOIN readings r ON r.mprn = c.hdf_mprn AND r.date BETWEEN c.bill_start AND c.bill_end WHERE block_reason IS NULL GROUP BY bill_idx),
ver AS (
  SELECT *, reads IS NOT NULL AS ok, coalesce(total, 0.0) AS hdf_total, coalesce(day, 0.0) AS hdf_day, coalesce(night, 0.0) AS hdf_night, coalesce(peak, 0.0) AS hdf_peak,
         coalesce(export, 0.0) AS hdf_export FROM checked LEFT JOIN met USING (bill_idx))"""

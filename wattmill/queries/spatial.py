"""Word-table queries on the scanned bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattmill.operators import extract as ex
from wattmill.operators import spatial as sp
from wattmill.queries.registry import query, rounded_sql
from wattmill.queries.views import BILL_LINES_SQL, ocr_words


def words(spark, sf):
    return sp.clean_words(ocr_words(spark, sf))


# Words of the scanned bills as printed; a word whose number falls on the gap has no text.
LINES_SQL = BILL_LINES_SQL + """,
printed AS (SELECT bill_id AS doc_id, layout, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_num FROM texts WHERE scanned),
tokens AS (
  SELECT doc_id, layout, line_num, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS word_num
  FROM printed),
kept AS (SELECT * FROM tokens WHERE (doc_id + (line_num - 1) * 7 + word_num - 1) % 97 <> 0)"""


@query(
    "ocr_lines",
    f"""WITH {LINES_SQL} SELECT doc_id, line_num::INTEGER AS line_num, string_agg(text, ' ' ORDER BY word_num) AS line, count(*) AS n
        FROM kept GROUP BY doc_id, line_num""",
)
def ocr_lines(spark, sf):
    lines = sp.text_lines(words(spark, sf))
    return lines.select("doc_id", "line_num", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("line"),
                        F.size("words").cast("bigint").alias("n"))


@query(
    "ocr_confidence",
    rounded_sql(
        """SELECT doc_id, avg(90 - (line_num - 1 + word_num - 1) % 7)::DOUBLE AS avg_ocr_confidence FROM kept GROUP BY doc_id""",
        "avg_ocr_confidence", LINES_SQL),
)
def ocr_confidence(spark, sf):
    return sp.document_confidence(words(spark, sf))


@query("ocr_anchors")
def ocr_anchors(spark, sf):
    return sp.best_anchors(sp.find_anchors(sp.text_lines(words(spark, sf))))


@query("ocr_values")
def ocr_values(spark, sf):
    return sp.spatial_fields(words(spark, sf))


# Documents whose label and value words are all legible give the printed value.
@query(
    "ocr_fields",
    f"""WITH {LINES_SQL}, lost AS (SELECT DISTINCT doc_id FROM tokens WHERE (doc_id + (line_num - 1) * 7 + word_num - 1) % 97 = 0)
        SELECT bill_id AS doc_id, mprn, printf('%.2f', net) AS subtotal, CAST(dk AS VARCHAR) AS day_kwh, '9' AS vat_rate
        FROM vals WHERE layout = 0 AND scanned AND bill_id NOT IN (SELECT doc_id FROM lost)""",
)
def ocr_fields(spark, sf):
    source = ocr_words(spark, sf)
    lost = source.filter("conf = -1").select("doc_id").distinct()
    legible = sp.clean_words(source.join(lost, "doc_id", "left_anti"))
    out = sp.extract_spatial(legible).filter("detected_provider = 'Energia'")
    return out.select("doc_id", *[ex.value_of(f).alias(f) for f in ("mprn", "subtotal", "day_kwh", "vat_rate")])

"""Contiguous shards of equal bytes by global prefix sums.

Documents stand in doc_id order. Each range of doc_ids adds up its own sizes; prefix sums over those few totals give
every range its base, and base plus running sum is a document's place on the line of all bytes. The line is cut at equal
targets, and a document belongs to the shard that holds its middle byte: shards are contiguous in doc_id, and each
differs from its target by less than the largest document.

A null text has size 1 and the checksum of an empty text; null doc_ids come first; documents of one doc_id are ordered by
checksum and size, equal rows by chance (their rows are the same); an empty table gives no row. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.common import range_bucket, read_table, shuffle_width, written

NAME = "op10_byte_shards"
SHARDS = 8
# DuckDB has no crc32: the table of bytes follows from the polynomial, and each text is folded byte by byte.
SQL = f"""
WITH t AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS crc FROM range(256) AS r (i)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size
      FROM documents),
s AS (SELECT *, sum(size) OVER () AS total,
             coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
p AS (SELECT *, least({SHARDS - 1}, (2 * before + size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, xor(list_reduce(
         [4294967295::BIGINT] || list_transform(range(0, length(h) // 2),
                                                lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM p, t
"""


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (place in the shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(text).alias("text_crc32"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    line = written(range_bucket(narrow, "doc_id", shuffle_width(spark), docs.select("doc_id")).select(
        "bucket", "doc_id", "size", "text_crc32", (F.row_number().over(inside) - 1).cast("long").alias("row"),
        F.coalesce(F.sum("size").over(running), F.lit(0)).alias("byte")), "line")

    totals = line.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    bases = totals.select("bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"),
                          F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    middle = 2 * (F.col("byte") + F.col("byte_base")) + F.col("size")
    placed = line.join(F.broadcast(bases), "bucket").select(
        "doc_id", "size", "text_crc32", (F.col("row") + F.col("row_base")).alias("global_row"),
        middle.alias("middle"), "all_bytes")
    cut = placed.selectExpr("doc_id", "size", "text_crc32", "global_row",
                            f"cast(least({shards - 1}, middle * {shards} div (2 * all_bytes)) as int) as shard")
    firsts = cut.groupBy("shard").agg(F.min("global_row").alias("first_row"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("global_row") - F.col("first_row")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

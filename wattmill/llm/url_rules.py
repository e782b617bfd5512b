"""URL rules by a sorted sweep over reversed hosts.

A host is turned round label by label (`www.example.com` becomes `com.example.www.`), so a host and all its subdomains
are one interval of keys. A rule is such an interval for the urls whose path starts with its path; the intervals of one
path are nested or apart. Each rule opens at its key and closes after its last subdomain; where it closes, the rule
around it (the next on the stack of open rules) is the innermost again. So the rules of a path are a sorted list of
points, each with the innermost rule from there on, and a url has the rule of the last point at or before its key: one
sort of urls and points together and one running `last`.

Equal (host, path) pairs are judged once. A url meets only the points of its top label and of the rule paths that start
its own path; urls are dealt to salted groups and the few points copied into each, so a label that holds most urls is
spread over all tasks. Of several rules the longest wins (characters of host and path, then of the host); of equal rules
with different verdicts, block. No rule: the default verdict.

A null url or one without `://` has an empty host and path. Repeated rows keep their own row each. Rules with a null or
empty host are left out; a null rule path is empty and fits all paths. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattmill.llm.common import fits, read_table, shuffle_width

NAME = "op5_url_rules"
DEFAULT = "allow"
MOST_BROADCAST = 200_000
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
VALUES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def top_label(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def points(rules: DataFrame) -> DataFrame:
    """rule_path, key and the innermost rule (`state`; a null rule in it: none) from this key on."""
    named = rules.filter("rule_host <> ''").groupBy("rule_host", F.coalesce("rule_path", F.lit("")).alias("rule_path")) \
        .agg(F.max("verdict").alias("verdict"))
    named = named.withColumn("key", reversed_key(F.col("rule_host"))).withColumn("state", F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")))
    labels = F.split("key", r"\.")
    around = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(
        F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    outer = named.select("rule_path", "key", around.alias("outer_key")).filter("outer_key <> key").join(
        named.select("rule_path", F.col("key").alias("outer_key"), F.col("state").alias("outer_state")),
        ["rule_path", "outer_key"]).groupBy("rule_path", "key").agg(F.max("outer_state").alias("outer_state"))
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("host_size"), F.lit(None).cast("string").alias("rule"),
                    F.lit(None).cast("string").alias("verdict"))
    closing = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))  # the character after "."
    closed = named.join(outer, ["rule_path", "key"], "left").select(
        "rule_path", closing.alias("key"), F.coalesce("outer_state", none).alias("state"))
    return named.select("rule_path", "key", "state").unionByName(closed)


def swept(urls: DataFrame, rules: DataFrame, salts: int) -> DataFrame:
    """host, path and `best` (the longest fitting rule) of each distinct pair that has a rule."""
    marks = points(rules)
    paths = marks.select("rule_path").distinct()
    paths = F.broadcast(paths) if fits(paths, MOST_BROADCAST) else paths
    sizes = sorted(r[0] for r in paths.select(F.length("rule_path")).distinct().collect())  # at most a path's length
    if not sizes:
        return urls.select("host", "path", F.lit(None).cast(marks.schema["state"].dataType).alias("best")).limit(0)
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("rule_path")) for n in sizes])
    fitting = urls.select("host", "path", F.explode(F.filter(starts, lambda s: F.length("path") >= s["n"])).alias("s")) \
        .select("host", "path", "s.rule_path").join(paths, "rule_path", "left_semi")
    asked = fitting.withColumn("key", reversed_key(F.col("host"))).select(
        "rule_path", "key", top_label(F.col("key")).alias("top"),
        F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        F.lit(None).cast(marks.schema["state"].dataType).alias("state"), "host", "path")
    top = F.regexp_extract("key", "^([^./]*)", 1)
    copied = marks.select("rule_path", "key", top.alias("top"),
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"),
                          "state", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = Window.partitionBy("rule_path", "top", "salt").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (asked.unionByName(copied).withColumn("open", F.last("state", ignorenulls=True).over(sweep))
            .filter("kind = 1 and open.rule is not null").groupBy("host", "path").agg(F.max("open").alias("best")))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = swept(split.select("host", "path").distinct(), rules, shuffle_width(pages.sparkSession))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {VALUES} AS r(rule_host, rule_path, verdict)")
    return judged(read_table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}',
                   '{string.ascii_lowercase}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r (rh, rp, verdict) AS (VALUES {VALUES}),
m AS (SELECT p.rid, r.*, row_number() OVER (PARTITION BY p.rid ORDER BY length(rh) + length(rp) DESC,
                                            length(rh) DESC) AS k
      FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT p.page_id, p.host, p.path, m.rh || m.rp AS rule, coalesce(m.verdict, '{DEFAULT}') AS verdict
FROM p LEFT JOIN m ON m.rid = p.rid AND m.k = 1
"""

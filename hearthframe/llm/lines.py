"""Cross-site boilerplate lines by HyperLogLog spread, in DataFrame operations only.

Per line hash, sketches of the sites that carry it merge by aggregation. Lines whose estimate is clear of the
threshold are decided by it; lines near the threshold get an exact count of distinct sites. Boilerplate lines are then
taken out of every document.

A line is what stands between newlines, without blanks, tabs and carriage returns at its ends; empty lines are no
lines and stay. A null source is a site of its own. Null and empty texts have no lines and stay as they are (null as
empty). Repeated rows are cleaned alike. A line on every document is one group of the aggregation and is combined
before the shuffle; the join that finds a document's boilerplate lines is one that Spark splits when a key is hot. Texts of any
length are read whole: the lines that go are places in the text, and what stays is cut out between them, so the work of a text
grows with its lines. Columns other than doc_id, source and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table, text_or_empty

MIN_SITES = 10
LG_K = 10
#: Standard error of an estimate at this size, times four: estimates farther from the threshold decide.
BAND = 4 * 1.04 / (1 << LG_K) ** 0.5
STRIP = " \t\r"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIP))


def line_hashes(text: Column) -> Column:
    """A hash for each line, in order; null for an empty one."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(bare(x) != "", F.xxhash64(bare(x))))


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes ``h`` of lines on at least min_sites distinct sites; lines: (site, hashes)."""
    low, high = min_sites - max(2.0, BAND * min_sites), min_sites + max(2.0, BAND * min_sites)
    each = lines.select("site", F.explode(F.array_distinct("hashes")).alias("h")).filter("h IS NOT NULL")
    spread = each.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")).filter(F.col("sites") >= low)
    spread = scratch.write(spread, "spread")
    near = spread.filter(F.col("sites") <= high).select("h")
    exact = each.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(F.col("sites") > high).select("h").unionByName(exact.select("h"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of (doc_id, source, text) rows, boilerplate lines taken out."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("site"), text_or_empty("text").alias("text"))
    keyed = rows.withColumn("th", F.xxhash64("text"))
    lines = scratch.write(keyed.select("doc_id", "th", "site", line_hashes(F.col("text")).alias("hashes")).filter(F.exists("hashes", lambda h: h.isNotNull())), "hashes")
    out = scratch.write(boilerplate(lines, scratch, min_sites), "boilerplate")
    hits = lines.select("doc_id", "th", F.posexplode("hashes").alias("at", "h")).join(out, "h").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "gone")
    made = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without(F.split("text", "\n", -1), F.col("gone")), "\n"))
    n_lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: bare(x) != ""))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return made.select("doc_id", kept.alias("text"), n_lines.cast("bigint").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_removed).cast("bigint").alias("n_removed"))


def without(every: Column, gone: Column) -> Column:
    """The elements but those at the places gone (from 0, in order): the runs between them, put together. Linear in both."""
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.lit(None).cast("int"))), lambda a, b: F.struct((a + 2).alias("first"), b.alias("end")))
    # A one-element array holds the list, so that it is made once and not for each run.
    cut = lambda e: F.flatten(F.transform(runs, lambda r: F.slice(e, r["first"], F.greatest(F.lit(0), F.coalesce(r["end"], F.size(e)) - r["first"] + 1))))
    return F.transform(F.array(every), cut)[0]


def op6_line_spread_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    return clean(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
g AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
m AS (SELECT b.*, (bare IN (SELECT bare FROM g)) AS gone FROM b)
SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m GROUP BY rid, doc_id
"""

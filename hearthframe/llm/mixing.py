"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Its source is cut into ranges of that key; word counts are summed by (source,
range), prefix sums over the ranges give each range its start, and rows are summed within their range. A source gives
whole epochs first, then documents in key order up to its exact budget; the document on the cut gives its first words.

Null and empty texts have size 0 and are never taken; texts of any length are counted whole. A null source is a source
of its own, last in order. Rows without an id take part; their keys come from their texts, so many of them are no hot
range. Repeated rows are documents of their own; of rows with one key those come first that have the smaller id, then
the smaller size. Columns of the input may bear any name, those of the results too: ``stage`` carries them apart. An
empty table gives an empty result.

Texts are read once for their sizes and keys, which are written down; ``source_targets`` sorts the table of sources,
one row a source, never rows of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table, text_or_empty

#: Weights of the sources in order of code point, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def random_key(doc_id: str, text: str, seed: str = SEED) -> Column:
    """Hash-random key of an id; of the text where there is no id."""
    known = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(text_or_empty(text).cast("binary"))))
    return F.md5(F.concat(F.lit(seed + ":"), known).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source its words and target, from (source, source_size) rows, one a source.

    Weight sharing with ceilings has a closed form: sources that end at their ceiling are those of least ceiling per
    weight. Sorted so, the first source whose share of what is left stays within its ceiling sets the rate of all
    from there on. Only the table of sources is sorted, never rows of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rated = ranked.withColumns(
        {
            "left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(earlier), F.lit(0)),
            "weight_left": F.sum("weight").over(later),
        }
    ).withColumn("rate", F.col("left") / F.col("weight_left"))
    settled = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("ceiling"), F.col("rate"))).over(everything)
    target = F.least(F.col("ceiling").cast("double"), F.coalesce(settled, F.col("ceiling").cast("double")) * F.col("weight"))
    return rated.withColumn("rate_all", settled).select("source", "weight", "source_size", F.when(F.col("rate_all").isNull(), F.col("ceiling").cast("double")).otherwise(target).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken) and the carried columns, of rows (doc_id, source, size, __key).

    Ranges are the first two hex digits of the key: 256 a source, so a source that holds a third of all rows is
    summed by 256 tasks.
    """
    carry = carry or []
    rows = docs.select("doc_id", "source", "size", "__key", *carry).withColumn("__range", F.substring("__key", 1, 2))
    ranges = rows.groupBy("source", "__range").agg(F.sum("size").alias("__words"))
    before = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, most)
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("__source"), F.col("s.__range").alias("__of"), "__start", "source_size", "target"
    )
    within = Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), budget - F.col("__start") - F.col("__before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), *carry)


def sized(docs: DataFrame, carry: list[str] | None = None, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), random_key("doc_id", "text", seed).alias("__key"), *(carry or []))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    rows = Scratch(spark, "mixing").write(sized(docs), "sizes")  # no texts; read several times from here on
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each whole time a document is taken, and one with its first words where the budget cuts it."""
    given = docs.columns
    whole_row = F.struct(*[F.col(f"`{c}`") for c in given]).alias("__row")
    mixed = mix(sized(docs.select("doc_id", "source", "text", whole_row), ["__row"]), carry=["__row"]).select("__row", "size", "taken")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = mixed.withColumn("__words", F.explode(copies))
    text = F.col("__row.text")
    gaps = F.split(text, WORD, -1)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    first = F.concat_ws("", F.flatten(F.zip_with(F.slice(gaps, 1, F.col("__words")), F.slice(words, 1, F.col("__words")), lambda g, w: F.array(g, w))))
    cut = out.withColumn("__text", F.when(F.col("__words") < 0, text).otherwise(first))
    whole_text = F.col("__words") < 0
    made = {"text": F.col("__text"), "n_chars": F.when(whole_text, F.col("__row")["n_chars"]).otherwise(F.length("__text").cast("bigint")) if "n_chars" in given else None}
    return cut.select(*[(made[c] if c in made else F.col("__row")[c]).alias(c) for c in given])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (o - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS ceiling FROM s),
r AS (
  SELECT *, (SELECT sum(source_size) FROM w) * 1.5e0
         - coalesce(sum(ceiling) OVER (ORDER BY ceiling / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY ceiling / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
l AS (SELECT max(CAST(rest AS DOUBLE) / weight_left) FILTER (WHERE CAST(rest AS DOUBLE) / weight_left * weight <= ceiling) AS rate FROM r),
t AS (SELECT source, source_size, least(CAST(ceiling AS DOUBLE), coalesce(rate * weight, CAST(ceiling AS DOUBLE))) AS target FROM r, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM c
"""

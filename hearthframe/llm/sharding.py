"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key and the number of shards alone decide a row's shard; no ring table is kept. When a shard is appended, a row
either stays or moves into the new shard, and 1/(n+1) of the keys do so.

Null keys hash as the key 0. Rows of equal key share a shard. Ranges within a shard follow a hash of the whole row, so
many rows without a key, or of one key, are no hot range unless their texts are equal, too. Null and empty texts have
the size of the row alone; texts of any length count whole. Repeated rows and ties get slots of their own. An empty
table gives an empty result. Columns of the input that bear a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table, text_or_empty, with_columns

#: Fixed values of the published hash: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
#: Ranges of hashed keys within a shard, each numbered by a task of its own.
RANGES = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys at once; the loop runs as often as the longest chain of jumps."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    """Shard of a bigint key as a column."""

    @F.pandas_udf("int")
    def udf(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return udf(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def range_column(*parts: Column, ranges: int = RANGES) -> Column:
    """Range of a row within its shard, by a hash of what makes the row."""
    return F.pmod(F.xxhash64(*parts), F.lit(ranges)).cast("int")


def number_slots(df: DataFrame, shard: str, bucket: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, without one task per shard.

    Rows are counted by (shard, bucket); prefix sums of these few counts give each bucket its first number, and the
    rows of a bucket are numbered on their own.
    """
    counts = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("__shard"), F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(shard, bucket).orderBy(*order)
    numbered = df.withColumn("__row", F.row_number().over(within))
    joined = numbered.join(first, (F.col(shard) == F.col("__shard")) & (F.col(bucket) == F.col("__bucket")))
    return joined.withColumn(slot, (F.col("__first") + F.col("__row") - 1).cast("bigint")).drop("__row", "__shard", "__bucket", "__first")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, column: str = "shard") -> DataFrame:
    """The rows with their shard; no shuffle."""
    return with_columns(df, {column: shard_column(F.col(f"`{key}`"), shards)})


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 24) -> None:
    """The rows as a folder per shard; each shard is written by several tasks, so a hot one doesn't wait on one."""
    spread = assign_shards(df, key, shards, "shard").withColumn("__range", range_column(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "shard"], ranges=8))
    spread.repartition("shard", "__range").drop("__range").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: size, checksum, shard, slot and the shard were there one more.

    Only ids, sizes and checksums are shuffled. Slots follow (range, doc_id, size, checksum), so repeated rows give
    the same set of rows in every run.
    """
    base = only(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 8).cast("bigint").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
    )
    key = F.col("doc_id")
    placed = base.withColumns({"shard": shard_column(key, shards), "grown_shard": shard_column(key, shards + 1), "__range": range_column(key, F.col("size"), F.col("text_crc32"))})
    numbered = number_slots(placed, "shard", "__range", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"), 24)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot, the last stage of the pipeline.

    Rows are numbered with their columns alongside: without a key that tells repeated rows apart, numbers could not be
    joined back.
    """
    crc = F.crc32(text_or_empty("text").cast("binary"))
    placed = assign_shards(docs, "doc_id", 24).withColumns({"__crc": crc, "__range": range_column(F.col("doc_id"), crc)})
    return number_slots(placed, "shard", "__range", ["doc_id", "__crc"]).drop("__range", "__crc")

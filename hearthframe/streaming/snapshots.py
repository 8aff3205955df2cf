"""Append-only snapshots as streams: the latest row of each key, first sights and counts, postings without repeats, and the cleaning projection.

A stream reads new files once (the checkpoint holds the offsets), and Spark's own state store keeps what is known of each
key. Every batch gives the keys it changed; they are written as a folder of the batch's number, so a batch that is run again
replaces itself, and the table is the last change of each key. A call that names a ``root`` goes on where the last one with that
root ended; without one it is a run of its own, whose folder is deleted when its result has been written. Empty sources give
empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthframe import shared_folder
from hearthframe.operators.graph import _settled


def file_stream(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _changes(stream: DataFrame, mode: str, root: str | None, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything there is now, in batches, then stop: table() of all changes, each with its ``__batch``."""
    spark = stream.sparkSession
    at = root or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{at}/changes/{number:012d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    fs, folder = _filesystem(spark, f"{at}/changes")
    schema = StructType(stream.schema.fields).add("__batch", "long")
    rows = spark.read.schema(schema).parquet(f"{at}/changes/*") if fs.exists(folder) else spark.createDataFrame([], schema)
    if root:
        return table(rows)
    kept = _settled(table(rows))
    fs, folder = _filesystem(spark, at)
    fs.delete(folder, True)
    return kept


def _last(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The last change of each key, nulls being a key."""

    def table(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "__batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")

    return table


def stream_latest(stream: DataFrame, keys: list[str], order: list[str], root: str | None = None) -> DataFrame:
    """The latest row of each key: an aggregate in the state store, given out when it changes."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return _changes(best, "update", root, _last(keys)).select(*stream.columns)


def stream_first_seen(stream: DataFrame, keys: list[str], seen: str, root: str | None = None) -> DataFrame:
    """(keys, first_seen, n_postings): least sight and number of postings of each key over all batches."""
    known = stream.groupBy(*keys).agg(F.min(seen).alias("first_seen"), F.count(F.lit(1)).alias("n_postings"))
    return _changes(known, "update", root, _last(keys))


def stream_unrepeated(stream: DataFrame, keys: list[str], at: str, delay: str, root: str | None = None) -> DataFrame:
    """The first row that comes of each key; a repeat within ``delay`` of event time ``at`` is dropped, and so is a row later than that.

    The state of a key goes when the watermark has passed it by the delay, so state is bounded by the rows of that time.
    """
    once = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return _changes(once, "append", root, lambda rows: rows.drop("__batch"))


def stream_project(stream: DataFrame, projection: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """A projection of new rows, appended to a table."""
    return _changes(projection(stream), "append", root, lambda rows: rows.drop("__batch"))

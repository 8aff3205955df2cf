"""Helpers shared by the corpus operators: table access, shared scratch tables, Arrow group streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe import importable_by_workers, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store it knows will do."""
    importable_by_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def scratch_mark() -> int:
    """A point in time to release scratch tables from."""
    return len(_MADE)


def release(spark: SparkSession, mark: int) -> None:
    """Delete the folders of operator calls made since the mark; for callers that have written down what they need."""
    for root in _MADE[mark:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _MADE[mark:]


class Scratch:
    """Intermediate tables of one operator call, written as Parquet below the shared folder.

    A written table cuts lineage: a lost executor costs the tasks it ran, not the steps before. ``drop`` removes
    a table once no returned plan reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable_by_workers(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/hearthframe/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _MADE.append(self.root)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, rows_a_group: int | None = None) -> DataFrame:
        """rows_a_group: for rows of long arrays; a reader unpacks a group of rows at once, so it bounds a task's memory."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if rows_a_group:
            writer = writer.option("parquet.block.row.count.limit", rows_a_group)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_all_but(self, *kept: str) -> None:
        self.drop(*sorted(self.names - set(kept)))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` that replaces columns of any clashing name, whatever its case."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[expr.alias(name) for name, expr in columns.items()])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named source columns under new names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def stream_groups(batches: Iterator[pa.RecordBatch], key: str | list[str]) -> Iterator[pa.Table]:
    """Groups of equal key from batches that arrive sorted by it; holds one group and one batch at a time."""
    keys = [key] if isinstance(key, str) else key
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tab = pa.Table.from_batches([batch])
        columns = [tab.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            change = change | (c[1:] != c[:-1])
        cuts = [0, *(change.nonzero()[0] + 1).tolist(), tab.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(tab.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


class Remembered(dict):
    """Values by key under a function, of which a bounded number is remembered; looked up without a Python call once known."""

    def __init__(self, made: Callable, most: int):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, key):
        value = self.made(key)
        if len(self) < self.most:
            self[key] = value
        return value

"""Connected components by alternating large and small stars (Kiveris et al., 2014), on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 40) -> DataFrame:
    """(node, label) for every node of an edge (u, v); label is the least node of its component.

    A star step is a minimum by node, combined before the shuffle, and a join that Spark splits when a node is hot;
    neighbours are never gathered. Each round is written to the shared folder, which cuts lineage; edges stay on the
    executors. No edges give no rows.
    """
    now = scratch.write(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before = _state(now)
    for r in range(1, most_rounds + 1):
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: u and its lower neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = scratch.write(small, f"{name}-{r}")
        if r > 1:
            scratch.drop(f"{name}-{r - 2}")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)

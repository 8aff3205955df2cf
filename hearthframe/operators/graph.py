"""Road graphs: edges, access nodes, shortest times and cumulative access, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe import shared_folder


def _settled(df: DataFrame) -> DataFrame:
    """Checkpointed to the shared folder, which cuts the lineage of a loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def road_edges(lines: DataFrame, speed: dict[int, float], fallback: float) -> DataFrame:
    """(u, v, minutes): both ways, the fastest of parallel edges; lines (id, kind, ring of (x, y)) in metres, speeds in km/h by kind."""
    v = lines.select("id", "kind", F.posexplode("ring").alias("pos", "v"))
    w = Window.partitionBy("id").orderBy("pos")
    seg = v.withColumn("n", F.lead("v").over(w)).filter("n IS NOT NULL")
    key = lambda p: F.concat_ws(",", F.round(F.col(f"{p}.x"), 1).cast("string"), F.round(F.col(f"{p}.y"), 1).cast("string"))
    pace = F.lit(fallback)
    for k, s in speed.items():
        pace = F.when(F.col("kind") == k, F.lit(s)).otherwise(pace)
    length = F.sqrt(F.pow(F.col("n.x") - F.col("v.x"), 2) + F.pow(F.col("n.y") - F.col("v.y"), 2))
    one = seg.select(key("v").alias("u"), key("n").alias("v"), (length / 1000 / pace * 60).alias("minutes"))
    return both_ways(one).groupBy("u", "v").agg(F.min("minutes").alias("minutes"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "minutes").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "minutes"))


def access_nodes(edges: DataFrame, kind: int) -> DataFrame:
    """Nodes where a road of the kind meets another kind; edges (src, dst, kind)."""
    ends = edges.select(F.col("src").alias("node"), "kind").unionByName(edges.select(F.col("dst").alias("node"), "kind"))
    return ends.groupBy("node").agg(F.count_distinct("kind").alias("k"), F.max((F.col("kind") == kind).cast("int")).alias("has")).filter("k > 1 AND has = 1").select("node")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges (u, v, minutes; both ways) of the component of most nodes, ties to the one with the least node; smaller fragments go."""
    from .duplicates import clusters

    label = _settled(clusters(edges.select(F.col("u").alias("rid")).distinct(), edges))
    first = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(1).select("cluster")  # one row
    return edges.join(label.join(F.broadcast(first), "cluster").select(F.col("rid").alias("u")), "u", "left_semi").select("u", "v", "minutes")


def shortest_times(edges: DataFrame, sources: DataFrame, cutoff: float = 60.0, most_rounds: int = 10_000) -> DataFrame:
    """(node, minutes) from the nearest source, up to the cutoff; see times_from_each. sources (node)."""
    return times_from_each(edges, sources.select(F.lit(0).alias("origin"), "node"), cutoff, most_rounds).select("node", "minutes")


def times_from_each(edges: DataFrame, origins: DataFrame, cutoff: float = 60.0, most_rounds: int = 10_000) -> DataFrame:
    """(origin, node, minutes): least time from each origin to every node within the cutoff, for all origins at once.

    edges (u, v, minutes) go both ways already; origins (origin, node), in any number, and an origin may have several nodes. A label
    is an origin's time at a node. Each round the labels that were improved in the round before go along the edges; labels over
    the cutoff, and all but the least of an origin at a node, are dropped before the shuffle, and only those that improve on
    the known time go on. Labels are spread by origin and node, so neither a busy node nor one origin's reach is a task of its own.
    A round's labels are checkpointed, all known ones every fourth round; rounds end when none improves. Paths of more edges than
    ``most_rounds`` raise an error rather than give times that are not the shortest. Unknown nodes or times lead nowhere.
    """
    roads = edges.filter("u IS NOT NULL AND v IS NOT NULL AND minutes >= 0").groupBy("u", "v").agg(F.min("minutes").alias("minutes"))
    best = _settled(origins.filter("node IS NOT NULL").select("origin", "node", F.lit(0.0).alias("minutes")).distinct())
    front = best
    for r in range(most_rounds):
        along = front.select("origin", F.col("node").alias("u"), F.col("minutes").alias("t")).join(roads, "u").select("origin", F.col("v").alias("node"), (F.col("t") + F.col("minutes")).alias("t"))
        reached = along.filter(F.col("t") <= cutoff).groupBy("origin", "node").agg(F.min("t").alias("t"))
        front = _settled(reached.join(best, ["origin", "node"], "left").filter(F.col("minutes").isNull() | (F.col("t") < F.col("minutes") - 1e-12)).select("origin", "node", F.col("t").alias("minutes")))
        if front.isEmpty():
            return best
        best = best.unionByName(front).groupBy("origin", "node").agg(F.min("minutes").alias("minutes"))
        if r % 4 == 3:
            best = _settled(best)
    raise RuntimeError(f"times still improve after {most_rounds} rounds")


def snap(points: DataFrame, nodes: DataFrame, pid: str, pace: float) -> DataFrame:
    """(pid, node, walk): the nearest node (node, x, y) of each point (pid, x, y), ties to the least, and the minutes to it at ``pace`` km/h;
    null for a point without coordinates."""
    from .spatial import nearest

    found = nearest(points, nodes.select("node", F.col("x").alias("px"), F.col("y").alias("py")), pid, "node")
    return found.select(pid, "node", (F.col("dist") / 1000 / pace * 60).alias("walk"))


def spread_amounts(cells: DataFrame, totals: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """The cells (cell, unit, ...) with one column for each weighting: their unit's total (unit, total) shared out by the weight.

    A unit whose weights add up to nothing gives nothing, nor does an unknown weight or a cell without unit.
    """
    named = cells.withColumns({f"__{k}": F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0)) for k, w in weights.items()})
    sums = named.groupBy("unit").agg(*[F.sum(f"__{k}").alias(f"__s{k}") for k in weights])
    met = named.join(sums.join(totals.select("unit", "total"), "unit"), "unit", "left")
    share = lambda k: F.coalesce(F.when(F.col(f"__s{k}") > 0, F.col("total") * F.col(f"__{k}") / F.col(f"__s{k}")), F.lit(0.0))
    return met.select(*cells.columns, *[share(k).alias(k) for k in weights])


def access_by_origin(times: DataFrame, origins: DataFrame, cells: DataFrame, amounts: list[str], limits: tuple[int, ...] = (30, 45, 60)) -> DataFrame:
    """A row an origin (origin, access, and ``amount_limit`` for each): what lies within each limit of door-to-door minutes.

    times (origin, node, minutes); origins (origin, node, walk); cells (node, walk and the amounts). Minutes are the walk to the
    origin's node, the way, and the walk from the cell's node. An origin that reaches nothing has zeros. Cells of one node
    and walk are added up before they meet the times.
    """
    names = [f"{a}_{m}" for a in amounts for m in limits]
    held = cells.filter("node IS NOT NULL AND walk IS NOT NULL").groupBy("node", "walk").agg(*[F.sum(a).alias(a) for a in amounts])
    door = times.join(origins.select("origin", F.col("walk").alias("__out")), "origin").select("origin", "node", (F.col("minutes") + F.col("__out")).alias("__t")).filter(F.col("__t") <= max(limits))
    met = door.join(held, "node").withColumn("__t", F.col("__t") + F.col("walk")).filter(F.col("__t") <= max(limits))
    sums = met.groupBy("origin").agg(*[F.sum(F.when(F.col("__t") <= m, F.col(a)).otherwise(0.0)).alias(f"{a}_{m}") for a in amounts for m in limits])
    return origins.select("origin", F.col("walk").alias("access")).join(sums, "origin", "left").select("origin", "access", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def cumulative_access(times: DataFrame, opportunities: DataFrame, limits: tuple[int, ...] = (30, 45, 60)) -> DataFrame:
    """One row of sums of opportunities (node, amount) within each limit of the times (node, minutes)."""
    met = times.join(opportunities, "node")
    return met.agg(*[F.coalesce(F.sum(F.when(F.col("minutes") <= m, F.col("amount"))), F.lit(0.0)).alias(f"within_{m}") for m in limits])

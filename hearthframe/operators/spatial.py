"""Spatial joins and statistics. Points, places, lines and units meet by leaves of packed trees (``tree``), never by all pairs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.functions.geo import distance, in_ring, segment_distance

from . import tree
from .graph import _settled
from .relational import exact_quantiles, value_ranks


#: Pieces of lines a leaf: they are narrowed one by one before they are sent.
LINES = 4 * tree.HELD


def _cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def point_in_unit(points: DataFrame, units: DataFrame, pid: str, unit: str, ring: str = "ring") -> DataFrame:
    """(pid, unit) of the first unit (by id) that holds each point; points in none, and without coordinates, are left out."""
    end = lambda f, c: f(F.transform("__ring", lambda v: v[c].cast("double")))
    p = tree.build(points.select(pid, "x", "y"), _at("x", "y"))
    u = tree.build(units.select(F.col(unit).alias("__unit"), F.col(ring).alias("__ring")), tuple(end(f, c) for f in (F.array_min, F.array_max) for c in "xy"), capacity=tree.SMALL)
    met = tree.leaves_within(p, u, 0.0, whole=False).met().filter(in_ring(F.col("x"), F.col("y"), F.col("__ring")))
    return met.groupBy(pid).agg(F.min("__unit").alias(unit))


def analysis_unit(tagged: DataFrame, small: str, large: str, least: int) -> DataFrame:
    """Adds analysis_unit: the small unit where it has enough points, else the large one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(small))
    return tagged.withColumn("analysis_unit", F.when(n >= least, F.concat(F.lit("s"), F.col(small).cast("string"))).otherwise(F.concat(F.lit("l"), F.col(large).cast("string"))))


def hex_grid(spark_df: DataFrame, size: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(hex_id, x, y) centres of flat-topped hexagons over a box, numbered row by row. spark_df lends its session."""
    dx, dy = 1.5 * size, 3**0.5 * size
    cols, rows = int((x1 - x0) // dx) + 2, int((y1 - y0) // dy) + 2
    grid = spark_df.sparkSession.range(cols * rows).select(F.col("id").alias("hex_id"), (F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    return grid.select("hex_id", (x0 + F.col("c") * dx).alias("x"), (y0 + F.col("r") * dy + F.when(F.col("c") % 2 == 1, dy / 2).otherwise(0.0)).alias("y"))


def hex_grid_over(points: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """hex_grid over the box of the points (x, y), widened by the margin; none for no points."""
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).collect()[0]
    if box["x0"] is None:
        return hex_grid(points, size, 0.0, 0.0, 0.0, 0.0).limit(0)
    return hex_grid(points, size, box["x0"] - margin, box["y0"] - margin, box["x1"] + margin, box["y1"] + margin)


def _at(x: str, y: str) -> tuple[Column, Column, Column, Column]:
    return F.col(x), F.col(y), F.col(x), F.col(y)


def _unplaced(points: DataFrame, pid: str) -> DataFrame:
    return points.filter(~tree.known(F.col("x").cast("double"), F.col("y").cast("double"))).select(pid)


def _numbers(t: pa.Table, *names: str) -> np.ndarray:
    return np.column_stack([t[c].cast(pa.float64()).to_numpy() for c in names])


def _away(at: np.ndarray, x, y) -> np.ndarray:
    """Distances to points, by the same arithmetic as ``distance``."""
    dx, dy = at[:, 0] - x, at[:, 1] - y
    return np.sqrt(dx * dx + dy * dy)


def _off(seg: np.ndarray, x, y) -> np.ndarray:
    """Distances to segments, by the same arithmetic as ``segment_distance``."""
    ax, ay, dx, dy, square = seg.T
    at = np.clip(np.divide((x - ax) * dx + (y - ay) * dy, square, out=np.zeros(np.broadcast(x, ax).shape), where=square > 0), 0.0, 1.0)
    px, py = ax + at * dx - x, ay + at * dy - y
    return np.sqrt(px * px + py * py)


def _block(held: tree.Tree):
    return lambda n: tree.block_of(n, held.n)


def count_within(points: DataFrame, poi: DataFrame, pid: str, radius: float) -> DataFrame:
    """(pid, n) of places within the radius, 0 where none, null for a point without coordinates.

    Groups of places that lie within the radius as a whole are counted by their number, without meeting their rows.
    """
    q = tree.build(poi.select("px", "py"), _at("px", "py"), capacity=tree.HELD)
    p = tree.build(points.select(pid, "x", "y"), _at("x", "y"), capacity=_block(q))
    return _count_within(p, q, pid, radius).unionByName(_unplaced(points, pid), allowMissingColumns=True)


def _kept(p: tree.Tree, pid: str, carry: str) -> tuple[list[str], str]:
    """The columns of a tree's points that an answer keeps, by a DDL list of those beside the id, and the DDL of all."""
    return [pid, *[c.split()[0] for c in carry.split(", ") if c]], ", ".join([f"`{pid}` {dict(p.items.dtypes)[pid]}", *([carry] if carry else [])])


def _count_within(p: tree.Tree, q: tree.Tree, pid: str, radius: float, carry: str = "") -> DataFrame:
    """count_within of the points of a tree, which keep the columns of a DDL list ``carry``."""
    kept, kind = _kept(p, pid, carry)

    def count(own: pa.Table, places: pa.Table) -> pa.Table:
        xy, at, n = _numbers(own, "x", "y"), _numbers(places, "px", "py"), own["inside"].to_numpy().copy()

        def near(part, middle, way, rows):
            d, slack = _away(at[rows], *middle), way + 1e-9 * (radius + way)
            sure = d <= radius - slack
            n[part] += sure.sum()
            return rows[~sure & (d <= radius + slack)]

        def answer(part, rows):
            n[part] += (_away(at[rows], xy[part, :1], xy[part, 1:]) <= radius).sum(1)

        tree.narrowed(xy, np.arange(len(at)), near, answer)
        return own.select(kept).append_column("n", pa.array(n))

    return tree.leaves_within(p, q, radius, wider=tree.WIDER).each(count, f"{kind}, n bigint")


def _mean_within(p: tree.Tree, q: tree.Tree, pid: str, radius: float, carry: str = "") -> DataFrame:
    """(pid, mean) of the numbers ``value`` of places (px, py, value; none null) within the radius of a tree's points, null where none are."""
    kept, kind = _kept(p, pid, carry)

    def mean(own: pa.Table, places: pa.Table) -> pa.Table:
        xy, at, value = _numbers(own, "x", "y"), _numbers(places, "px", "py"), _numbers(places, "value")[:, 0]
        n, total = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows)

        def near(part, middle, way, rows):
            d, slack = _away(at[rows], *middle), way + 1e-9 * (radius + way)
            sure = d <= radius - slack
            n[part] += sure.sum()
            total[part] += value[rows[sure]].sum()
            return rows[~sure & (d <= radius + slack)]

        def answer(part, rows):
            hit = _away(at[rows], xy[part, :1], xy[part, 1:]) <= radius
            n[part] += hit.sum(1)
            total[part] += np.where(hit, value[rows], 0.0).sum(1)

        tree.narrowed(xy, np.arange(len(at)), near, answer)
        return own.select(kept).append_column("mean", pa.array(total / np.maximum(n, 1), mask=n == 0))

    return tree.leaves_within(p, q, radius, whole=False, wider=tree.WIDER).each(mean, f"{kind}, mean double")


def around(points: DataFrame, poi: DataFrame, segments: DataFrame, cells: DataFrame, pid: str, radius: float, buffer: float) -> DataFrame:
    """(pid, x, y, n, dist, mean) of every point: places (px, py) within the radius, distance to the nearest segment (ax, ay, bx, by), and the
    mean value of the cells (cx, cy, value) within the buffer; null where there is none, or the point has no coordinates.

    The points are sorted and written once, and go from one answer to the next with what they have, so the answers are not joined.
    """
    places = tree.build(poi.select("px", "py"), _at("px", "py"), capacity=tree.HELD)
    held = tree.build(cells.select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL"), _at("px", "py"), capacity=tree.HELD)
    own = points.select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = tree.build(own, _at("x", "y"), capacity=lambda n: tree.block_of(n, 0))

    def beside(q: tree.Tree, items: DataFrame) -> tree.Tree:
        size = tree.block_of(p.n, q.n)
        return replace(p if size == p.capacity else p.cut(size), items=items)

    carry = "x double, y double, __at bigint"
    counted = _count_within(beside(places, p.items), places, pid, radius, carry)
    lined = _nearest_line(replace(p, items=counted), segments, pid, f"{carry}, n bigint")
    met = _mean_within(beside(held, lined), held, pid, buffer, f"{carry}, n bigint, dist double").drop("__at")
    return met.unionByName(own.filter(~tree.known(F.col("x"), F.col("y"))), allowMissingColumns=True)


def nearest(points: DataFrame, poi: DataFrame, pid: str, poi_id: str) -> DataFrame:
    """(pid, poi, dist) of the nearest place of every point, however far, ties to the smaller id; null for a point without coordinates.

    Points without any place to be near to raise an error.
    """
    q = tree.build(poi.select(F.col(poi_id).alias("__poi"), "px", "py"), _at("px", "py"), capacity=tree.HELD)
    p = tree.build(points.select(pid, "x", "y"), _at("x", "y"), capacity=_block(q))
    if p.n and not q.n:
        raise ValueError("no places to be near to")

    def best(own: pa.Table, places: pa.Table) -> pa.Table:  # in order of id, so the first of equal distances has the smaller one
        xy, at, d, of = _numbers(own, "x", "y"), _numbers(places, "px", "py"), np.empty(own.num_rows), np.empty(own.num_rows, int)

        def answer(part, rows):
            away = _away(at[rows], xy[part, :1], xy[part, 1:])
            first = away.argmin(1)
            d[part], of[part] = away[np.arange(len(part)), first], rows[first]

        tree.narrowed(xy, np.arange(len(at)), lambda part, middle, way, rows: rows[tree.within_reach(_away(at[rows], *middle), 1, way)], answer)
        return pa.table({pid: own[pid], poi_id: places["__poi"].take(pa.array(of)), "dist": d})

    kinds = dict(points.dtypes)[pid], dict(poi.dtypes)[poi_id]
    found = tree.nearest_leaves(p, q, wider=tree.WIDER).each(best, f"`{pid}` {kinds[0]}, `{poi_id}` {kinds[1]}, dist double", "__poi")
    return found.unionByName(_unplaced(points, pid), allowMissingColumns=True)


def _pieces(segments: DataFrame, points: tree.Tree, most: int = 256) -> DataFrame:
    """The segments, once for each piece about as long as a block of the points is wide, with the piece's number ``__i`` of ``__n`` and its ends: long lines have wide, mostly empty boxes."""
    e = points.leaves.agg(*[f(f"{c}{i}").alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]).collect()[0]
    width = max(e["x1"] - e["x0"], e["y1"] - e["y0"]) / max(1.0, points.n_leaves**0.5) if points.n else 0.0
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    n = F.least(F.lit(float(most)), F.ceil(length / width)).cast("int") if width > 0 else F.lit(1)
    cut = segments.withColumn("__n", F.greatest(F.lit(1), n)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    end = lambda c, i: F.when(i == F.col("__n"), F.col(f"b{c}")).otherwise(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (i / F.col("__n")))
    return cut.withColumns({f"__{k}{c}": end(c, i) for k, i in (("a", F.col("__i")), ("b", F.col("__i") + 1)) for c in "xy"})


def nearest_line(points: DataFrame, segments: DataFrame, pid: str) -> DataFrame:
    """(pid, dist) of every point to its nearest segment (ax, ay, bx, by), however far; null if there are no segments or the point has no coordinates."""
    return _nearest_line(tree.build(points.select(pid, "x", "y"), _at("x", "y"), capacity=lambda n: tree.block_of(n, 0)), segments, pid).unionByName(_unplaced(points, pid), allowMissingColumns=True)


def _nearest_line(p: tree.Tree, segments: DataFrame, pid: str, carry: str = "") -> DataFrame:
    """nearest_line of the points of a tree, which keep the columns of a DDL list ``carry``.

    A block's middle is d from its nearest line, so a line that is farther from it than d and the block's width is nearest to none
    of its points. Of a line's pieces only the one that lies nearest to the middle is sent, so a line is sent once to a block.
    """
    (kept, kind), names = _kept(p, pid, carry), ("ax", "ay", "bx", "by")
    ends = segments.select(*[F.col(c).cast("double").alias(c) for c in names]).filter(tree.known(*[F.col(c) for c in names]))
    low, high = (tuple(f(F.col(f"__a{c}"), F.col(f"__b{c}")) for c in "xy") for f in (F.least, F.greatest))
    q = tree.build(_pieces(ends, p), (*low, *high), capacity=LINES)
    q = replace(q, items=q.items.select(*names, "__i", "__n", "__leaf", "__at"))
    side = lambda c: F.col(f"l{c}1") - F.col(f"l{c}0")
    slip = 1e-9 * (1 + F.greatest(*[F.abs(f"l{c}{i}") for c in "xy" for i in "01"]))
    # The middle's nearest piece of a line that some point needs may lie half a block farther than what the block's box needs.
    found = tree.nearest_leaves(p, q, wider=4 * tree.WIDER, beyond=(side("x") + side("y")) / 2 + slip)
    way = F.sqrt(side("x") * side("x") + side("y") * side("y"))
    middle = found.state.select("key", "inside", "nodes", ((F.col("lx0") + F.col("lx1")) / 2).alias("mx"), ((F.col("ly0") + F.col("ly1")) / 2).alias("my"), (way * (1 + 1e-9) + slip).alias("way"))
    off = segment_distance(*[F.col(c) for c in ("mx", "my", *names)])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    foot = F.coalesce(F.try_divide((F.col("mx") - F.col("ax")) * dx + (F.col("my") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    piece = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), foot)) * F.col("__n")), F.col("__n") - 1)

    def beside(keys: DataFrame) -> DataFrame:
        return keys.withColumn("__other", F.explode("nodes")).drop("nodes").join(q.items.withColumnRenamed("__leaf", "__other"), "__other")

    nearest_to_middle = beside(middle).groupBy("key").agg(F.min(off).alias("__least"))
    state = _settled(middle.join(nearest_to_middle, "key", "left"))

    sent = beside(state).filter((F.col("__i") == piece) & (off <= F.col("__least") * (1 + 1e-9) + F.col("way"))).select("key", *names)

    def least(own: pa.Table, lines: pa.Table) -> pa.Table:
        xy, d = _numbers(own, "x", "y"), np.full(own.num_rows, np.nan)
        at = np.unique(_numbers(lines, *names), axis=0)
        step = at[:, 2:] - at[:, :2]
        seg = np.column_stack([at[:, :2], step, (step * step).sum(1)])

        def answer(part, rows):
            d[part] = _off(seg[rows], xy[part, :1], xy[part, 1:]).min(1)

        if len(at):
            tree.narrowed(xy, np.arange(len(at)), lambda part, middle, way, rows: rows[tree.within_reach(_off(seg[rows], *middle), 1, way)], answer)
        return own.select(kept).append_column("dist", pa.array(d, mask=np.isnan(d)))

    return replace(found, state=state.select("key", "inside", "nodes"), sent=sent).each(least, f"{kind}, dist double")


def count_up_to(limits: DataFrame, values: DataFrame, limit: str, value: str) -> DataFrame:
    """(limit, n): for each distinct limit the number of values at most it, by prefix sums over value ranges."""
    both = values.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("own")).unionByName(limits.select(F.col(limit).cast("double").alias("v"), F.lit(0).alias("own")).distinct())
    asked = both.filter("own = 0 AND v IS NOT NULL").select("v").distinct()
    # A limit among the values counts once itself, as does every limit below it; both are taken off again.
    all_of, of_limits = value_ranks(both, "v"), value_ranks(asked, "v")
    n = asked.join(all_of.select("v", (F.col("below") + F.col("c")).alias("a")), "v").join(of_limits.select("v", (F.col("below") + F.col("c")).alias("b")), "v")
    return n.select(F.col("v").alias(limit), (F.col("a") - F.col("b")).alias("n"))


def nearest_within_budget(origins: DataFrame, listings: DataFrame, oid: str) -> DataFrame:
    """(oid, dist, n): nearest listing whose rent is in the origin's budget, however far, and how many such listings there are; dist
    infinite and n 0 if none. dist is null for an origin without coordinates.

    Nodes of listings know their least rent, so one that has a listing in a group's budgets bounds how far the nearest can be.
    """
    q = listings.select("px", "py", "rent").filter("rent IS NOT NULL")
    o = origins.select(oid, "x", "y", F.col("budget").cast("double").alias("budget"))
    counts = count_up_to(o, q, "budget", "rent")
    held = tree.build(q, _at("px", "py"), F.col("rent"), tree.HELD)
    asking = tree.build(o, _at("x", "y"), F.col("budget"), _block(held))

    def best(own: pa.Table, homes: pa.Table) -> pa.Table:
        xy, budget, at, rent, d = _numbers(own, "x", "y"), _numbers(own, "budget")[:, 0], _numbers(homes, "px", "py"), _numbers(homes, "rent")[:, 0], np.full(own.num_rows, np.inf)

        def near(part, middle, way, rows):
            rows = rows[rent[rows] <= budget[part].max()]
            away, all_may = _away(at[rows], *middle), rent[rows] <= budget[part].min()
            reach = away[all_may].min(initial=np.inf) + 2 * way
            return rows[away <= reach + 1e-9 * (reach + 1)]

        def answer(part, rows):
            away = np.where(rent[rows] <= budget[part, None], _away(at[rows], xy[part, :1], xy[part, 1:]), np.inf)
            d[part] = away.min(1, initial=np.inf)

        tree.narrowed(xy, np.arange(len(at)), near, answer)
        return pa.table({oid: own[oid], "budget": budget, "dist": d})

    found = tree.nearest_leaves(asking, held, up_to_value=True, wider=tree.WIDER).each(best, f"`{oid}` {dict(origins.dtypes)[oid]}, budget double, dist double")
    placed = tree.known(F.col("x").cast("double"), F.col("y").cast("double"))
    rest = o.filter(~(placed & tree.known(F.col("budget")))).select(oid, "budget", F.when(placed, F.lit(float("inf"))).alias("dist"))
    return found.unionByName(rest).join(counts, "budget", "left").select(oid, "dist", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def knn_weights(areas: DataFrame, k: int) -> DataFrame:
    """(i, j, w): the k nearest other areas of each (id, x, y), ties to the smaller id, row-standardised; all others if there
    are fewer. An area without coordinates has no neighbours and is none."""
    own = tree.build(areas.select(F.col("id").alias("i"), "x", "y"), _at("x", "y"), capacity=tree.SMALL)
    others = replace(own, items=own.items.withColumnsRenamed({"i": "j", "x": "xj", "y": "yj"}))
    away = F.transform(F.filter("others", lambda o: o["j"] != F.col("i")), lambda o: F.struct(distance(F.col("x"), F.col("y"), o["xj"], o["yj"]).alias("d"), o["j"].alias("j")))
    best = tree.nearest_leaves(own, others, k + 1).beside().select("i", F.slice(F.array_sort(away), 1, k).alias("b"))  # one of the k + 1 is the area itself
    return best.select("i", F.explode("b.j").alias("j"), F.size("b").alias("n")).select("i", "j", (1.0 / F.col("n")).alias("w"))


def convex_hull(points: DataFrame) -> DataFrame:
    """(ord, x, y): the corners of the convex hull of the points (x, y), anticlockwise from the least x, then y; a single point or
    two ends where there are no more, none for no points. Unknown coordinates take no part.

    Each task keeps only the hull of what it has seen; the partial hulls are dealt out and merged again, then put together.
    """

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(corners):
        out: list = []
        for p in corners:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    def hull(corners: list) -> list:
        at = sorted(set(corners))
        return at if len(at) < 3 else chain(at)[:-1] + chain(at[::-1])[:-1]

    def merged(frames):
        held: list = []
        for f in frames:
            held = hull([*held, *zip(f["x"].tolist(), f["y"].tolist())])
        yield pd.DataFrame({"ord": range(len(held)), "x": [p[0] for p in held], "y": [p[1] for p in held]})

    kind = "ord int, x double, y double"
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    part = points.filter(tree.known(x, y)).select(x.alias("x"), y.alias("y")).mapInPandas(merged, kind)
    again = part.repartition(16).mapInPandas(merged, kind)  # sixteen hulls are left of any number
    return again.coalesce(1).mapInPandas(merged, kind)


def keep_near_hull(hexes: DataFrame, points: DataFrame, hid: str, size: float, reach: float = 3000.0) -> DataFrame:
    """Hexagons (flat-topped, of that size, by their centres x, y) that come within reach of the points' convex hull, or meet it."""
    ring = convex_hull(points).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("__h"))  # one row of corners
    ahead = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    corner = [(size, 0.0), (size / 2, 3**0.5 / 2 * size), (-size / 2, 3**0.5 / 2 * size), (-size, 0.0), (-size / 2, -(3**0.5) / 2 * size), (size / 2, -(3**0.5) / 2 * size)]
    own = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corner])
    met = hexes.join(F.broadcast(ring)).withColumn("__c", own)

    def gap(a: Column, b: Column) -> Column:
        """Least distance from a's corners to b's edges."""
        edges = F.arrays_zip(b.alias("p"), ahead(b).alias("q"))
        return F.array_min(F.transform(a, lambda p: F.array_min(F.transform(edges, lambda e: segment_distance(p["x"], p["y"], e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))))

    h, c = F.col("__h"), F.col("__c")
    inside = F.exists(c, lambda p: in_ring(p["x"], p["y"], h)) | F.exists(h, lambda p: in_ring(p["x"], p["y"], c))
    near = F.least(gap(c, h), gap(h, c)) <= reach
    return met.filter((F.size(h) > 0) & (inside | near)).select(*hexes.columns)


def ring_weights(rings: DataFrame, digits: int = 3) -> DataFrame:
    """(i, j, w): areas (id, ring) whose outlines share a corner, or where a corner of one lies on an edge of the other;
    row-standardised. Rings of any shape; coordinates are compared at ``digits`` decimals.

    Corners meet corners by equality; corners meet edges by the leaves of a packed tree of edges.
    """
    v = rings.select("id", F.transform("ring", lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))).alias("r")).filter(F.size("r") > 0)
    ahead = F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1))
    edges = v.select("id", F.explode(F.arrays_zip(F.col("r").alias("a"), ahead.alias("b"))).alias("e")).select(F.col("id").alias("j"), F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    corners = v.select(F.col("id").alias("i"), F.explode("r").alias("p")).select("i", "p.x", "p.y").distinct()
    low, high = (tuple(f(F.col(f"a{c}"), F.col(f"b{c}")) for c in "xy") for f in (F.least, F.greatest))
    p, q = tree.build(corners, _at("x", "y")), tree.build(edges, (*low, *high), capacity=tree.SMALL)
    near = tree.leaves_within(p, q, 10.0**-digits, whole=False).met().filter("i <> j")
    on = near.filter(segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]) <= 0.5 * 10.0**-digits).select("i", "j")
    pairs = on.unionByName(on.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    return pairs.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("i")))


def queen_weights(boxes: DataFrame) -> DataFrame:
    """(i, j, w): areas that share a vertex, row-standardised; an equi-join on vertices."""
    v = boxes.select("id", F.explode(F.array(*[F.struct(F.col(a).alias("vx"), F.col(b).alias("vy")) for a in ("x0", "x1") for b in ("y0", "y1")])).alias("v"))
    pairs = v.select(F.col("id").alias("i"), "v").join(v.select(F.col("id").alias("j"), "v"), "v").filter("i <> j").select("i", "j").distinct()
    return pairs.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("i")))


def contiguity_weights(boxes: DataFrame, k: int = 6) -> DataFrame:
    """queen_weights, or if any area shares no vertex with another, the k nearest centres of all areas."""
    w = queen_weights(boxes)
    if boxes.join(w.select(F.col("i").alias("id")), "id", "left_anti").isEmpty():
        return w
    return knn_weights(boxes.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), k)


def prepared_units(units: DataFrame, names: list[str], district: str, kept: list[str]) -> DataFrame:
    """Units of the kept districts, whatever their case, with trimmed names in title case."""
    return units.filter(F.upper(F.trim(district)).isin([k.upper() for k in kept])).withColumns({c: F.initcap(F.trim(c)) for c in names})


def dissolve(parts: DataFrame, unit: str, ring: str = "ring", digits: int = 3) -> DataFrame:
    """(unit, ax, ay, bx, by): the outline of each unit's parts taken together, by one aggregation over edges.

    An edge that two parts of a unit share lies inside it and goes, so parts must meet along whole edges and not overlap;
    coordinates are compared at ``digits`` decimals. Edges run from the smaller end; rings may repeat their first vertex,
    and rings that are null or have no edge give none.
    """
    v = F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    ahead = F.concat(F.slice("__v", 2, F.greatest(F.size("__v") - 1, F.lit(0))), F.slice("__v", 1, 1))
    edges = parts.select(unit, v.alias("__v")).select(unit, F.explode(F.arrays_zip(F.col("__v").alias("a"), ahead.alias("b"))).alias("e")).select(unit, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).filter("a <> b")
    return edges.groupBy(unit, "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(unit, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def _held(values: DataFrame) -> DataFrame:
    """The values (id, v) that are there: nulls and NaN take no part."""
    return values.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))


def local_moran(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, z, lag, local_i, quadrant) of values (id, v) with a neighbour that has a value; nulls and NaN take no part.

    Weights are used as they are. Of values that are all equal z is undefined: it and what follows from it are null.
    """
    held = _held(values)
    m = held.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = held.join(F.broadcast(m)).select("id", F.try_divide(F.col("v") - F.col("m"), F.col("s")).alias("z"))  # one row
    lag = weights.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    known = F.col("z").isNotNull() & F.col("lag").isNotNull()
    q = F.when(~known, F.lit(None)).when((F.col("z") >= 0) & (F.col("lag") >= 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when(F.col("z") >= 0, "HL").otherwise("LH")
    return z.join(lag, z["id"] == lag["i"]).select("id", "z", "lag", (F.col("z") * F.col("lag")).alias("local_i"), q.alias("quadrant"))


def moran_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (moran, expected, n) of row-standardised weights."""
    l = local_moran(values, weights)  # noqa: E741
    return l.agg(F.try_divide(F.sum("local_i"), F.sum(F.col("z") * F.col("z"))).alias("moran"), F.try_divide(F.lit(-1.0), F.count(F.lit(1)) - 1).alias("expected"), F.count(F.lit(1)).alias("n"))


def gi_star(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, gi): Getis-Ord z of binary weights that include the area itself. Nulls and NaN take no part; gi is null where it is
    undefined, as of an area that neighbours all others, or of values that are all equal."""
    held = _held(values)
    w = weights.select("i", "j").join(held.select(F.col("id").alias("i")), "i", "left_semi").select("i", "j").unionByName(held.select(F.col("id").alias("i"), F.col("id").alias("j")))
    m = held.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    g = w.join(held.select(F.col("id").alias("j"), "v"), "j").groupBy("i").agg(F.sum("v").alias("sv"), F.count(F.lit(1)).alias("k"))
    k, n = F.col("k"), F.col("n")
    scale = F.col("s") * F.sqrt(F.try_divide((n * k - k * k).cast("double"), (n - 1).cast("double")))
    return g.join(F.broadcast(m)).select(F.col("i").alias("id"), F.try_divide(F.col("sv") - F.col("m") * k, scale).alias("gi"))  # one row


def local_permutation(values: DataFrame, weights: DataFrame, permutations: int = 999, seed: int = 42, alpha: float = 0.05, most_units: int = 1_000_000) -> DataFrame:
    """(id, local_i, quadrant, p, cluster, gi, gi_p): local Moran and Getis-Ord statistics with conditional permutation p.

    An area keeps its value and draws as many neighbours as it has from all others, without repeats; p is the share of
    draws at least as far on the observed side. Areas are dealt to tasks, each with the values of all map units, of which
    there may be ``most_units``. Areas without neighbours, and null values, take no part.
    """
    held = _held(values).select("id", F.col("v").cast("double").alias("v"))
    known = weights.join(held.select(F.col("id").alias("i")), "i", "left_semi").join(held.select(F.col("id").alias("j")), "j", "left_semi")
    every = [r["v"] for r in held.orderBy("id").select("v").limit(most_units + 1).collect()]  # at most most_units numbers
    if len(every) > most_units:
        raise ValueError(f"more than {most_units} map units")
    shared = held.sparkSession.sparkContext.broadcast(np.array(every))
    order = held.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("at"))  # as many rows as map units
    near = known.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    own = known.join(held.select(F.col("id").alias("j"), "v"), "j").groupBy(F.col("i").alias("id")).agg(F.sum("v").alias("around"))
    rows = local_moran(held, known.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("i")))).join(near, "id").join(own, "id").join(order, "id").join(gi_star(held, known), "id")
    kind = dict(held.dtypes)["id"]

    def drawn(frames):
        v = shared.value
        n = len(v)
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.at)])
                chosen = np.empty((permutations, int(r.k)), np.int64)
                for c, top in enumerate(range(n - 1 - int(r.k), n - 1)):  # Floyd's sampling, all permutations at once
                    pick = rng.integers(0, top + 1, permutations)
                    chosen[:, c] = np.where((chosen[:, :c] == pick[:, None]).any(axis=1), top, pick)
                sums = v[chosen + (chosen >= int(r.at))].sum(axis=1)
                more, less = int((sums >= r.around - 1e-12).sum()), int((sums <= r.around + 1e-12).sum())
                p = (min(more, less) + 1) / (permutations + 1)
                label = {"HH": "High-High", "LL": "Low-Low", "HL": "High-Low", "LH": "Low-High"}[r.quadrant] if p < alpha else "Not significant"
                out.append((r.id, r.local_i, r.quadrant, p, label, r.gi, p))
            yield pd.DataFrame(out, columns=["id", "local_i", "quadrant", "p", "cluster", "gi", "gi_p"])

    return rows.select("id", "local_i", "quadrant", "k", "around", "at", "gi").mapInPandas(drawn, f"id {kind}, local_i double, quadrant string, p double, cluster string, gi double, gi_p double")


def spatial_blocks(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("block", F.concat_ws("_", _cell("x", size).cast("string"), _cell("y", size).cast("string")))


def class_edges(df: DataFrame, value: str, classes: int, scheme: str = "quantiles", grains: int = 512) -> DataFrame:
    """One row: the inner edges of the classes. quantiles; equal_interval; symmetric around 0 (thirds of the 97th
    percentile of the absolute values, six classes); fisher_jenks, the edges of least squared deviation within classes,
    exact for up to ``grains`` distinct values and over that many equal-count groups of neighbours beyond it.
    """
    v = F.col(value).cast("double")
    if scheme == "quantiles":
        return exact_quantiles(df, value, [i / classes for i in range(1, classes)], "__e")
    if scheme == "equal_interval":
        return df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).select(F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * (i / classes) for i in range(1, classes)]).alias("__e"))
    if scheme == "symmetric":
        step = exact_quantiles(df.select(F.abs(v).alias("__v")), "__v", [0.97]).select((F.col("q")[0] / 3).alias("s"))
        return step.select(F.array(*[F.col("s") * k for k in (-2, -1, 0, 1, 2)]).alias("__e"))
    if scheme != "fisher_jenks":
        raise ValueError(f"no scheme {scheme}")
    ranks = value_ranks(df, value)
    n = ranks.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
    grain = F.when(F.col("d") <= grains, F.col("v")).otherwise(F.floor(F.col("below") * grains / F.col("n")).cast("double"))
    cells = ranks.join(F.broadcast(n)).groupBy(grain.alias("g")).agg(F.max("v").alias("top"), F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("c")).alias("q"))  # one row
    edges = natural_edges([(r["top"], r["c"], r["s"], r["q"]) for r in cells.orderBy("top").collect()], classes)  # at most ``grains`` rows
    return df.sparkSession.range(1).select(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>").alias("__e"))


def natural_edges(cells: list[tuple[float, float, float, float]], classes: int) -> list[float]:
    """Tops of all classes but the last, by dynamic programming over cells (top, count, sum, sum of squares) in order of value."""
    n = len(cells)
    classes = min(classes, n)
    if classes < 2:
        return []
    c, s, q = (np.concatenate([[0.0], np.cumsum([x[i] for x in cells])]) for i in (1, 2, 3))
    cost = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (c[j] - c[i])  # noqa: E731  cells i to j - 1
    best = np.array([np.inf] + [cost(0, j) for j in range(1, n + 1)])
    cuts = []
    for k in range(2, classes + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(k, n + 1):
            i = np.arange(k - 1, j)
            total = best[i] + cost(i, j)
            at = int(total.argmin())
            new[j], cut[j] = total[at], i[at]
        best = new
        cuts.append(cut)
    edges, j = [], n
    for cut in reversed(cuts):
        j = cut[j]
        edges.append(cells[j - 1][0])
    return edges[::-1]


def class_breaks(df: DataFrame, value: str, classes: int, scheme: str = "quantiles") -> DataFrame:
    """Adds the class (from 0, right-closed) of each value; null for a null."""
    edges = class_edges(df, value, classes, scheme)
    return df.join(F.broadcast(edges)).withColumn("class", F.when(F.col(value).isNotNull(), F.size(F.filter("__e", lambda e: e < F.col(value))))).drop("__e")  # one row


def scaled_unit(df: DataFrame, value: str) -> DataFrame:
    """One row (unit, word): the thousands that suit the 75th percentile of the values, for labels; 1 for no values."""
    typical = df.agg(F.percentile(value, 0.75).alias("p"))
    unit = F.when(F.col("p") >= 1e9, 1e9).when(F.col("p") >= 1e6, 1e6).when(F.col("p") >= 1e3, 1e3).otherwise(1.0)
    return typical.select(unit.alias("unit")).withColumn("word", F.when(F.col("unit") == 1e9, "billion").when(F.col("unit") == 1e6, "million").when(F.col("unit") == 1e3, "thousand").otherwise(""))


def label_counts(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """(label, n) of all the labels, in any number, none included."""
    named = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    return named.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))

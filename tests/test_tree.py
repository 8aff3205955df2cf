"""The packed tree: same answers as brute force on uneven points, and bounded leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import spatial as S
from hearthframe.operators import tree


def uneven(rng, n):
    """Nine tenths of the points within a metre, a tenth of all on one spot, the rest over 100 km."""
    at = np.r_[rng.uniform(500, 501, (n * 8 // 10, 2)), np.repeat([[500.25, 500.75]], n // 10, axis=0), rng.uniform(-50_000, 50_000, (n - n * 8 // 10 - n // 10, 2))]
    return at[rng.permutation(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema)


def test_leaves_are_bounded_and_hold_every_row(spark):
    at = uneven(np.random.default_rng(1), 3000)
    t = tree.build(frame(spark, [(i, *p) for i, p in enumerate(at)], "pid int, x double, y double").repartition(3), tuple(F.col(c) for c in "xyxy"))
    leaves = t.leaves.collect()
    assert t.n == 3000 and t.items.count() == 3000 and max(r["n"] for r in leaves) <= tree.CAPACITY and len(leaves) <= 3000 / tree.CAPACITY + 4
    for k in range(t.height):
        nodes = t.level(k).collect()
        assert sum(r["n"] for r in nodes) == 3000 and len({r["node"] for r in nodes}) == len(nodes)
        assert {r["parent"] for r in nodes} == ({r["node"] for r in t.level(k + 1).collect()} if k + 1 < t.height else {0})


def test_uneven_points_get_the_same_answers_from_few_rows(spark, monkeypatch):
    monkeypatch.setattr(tree, "MOST_NODES", 8)
    rng = np.random.default_rng(2)
    at, goal = uneven(rng, 2000), uneven(rng, 1500)
    pts, poi = frame(spark, [(i, *p) for i, p in enumerate(at)], "pid int, x double, y double"), frame(spark, [(i, *p) for i, p in enumerate(goal)], "poi int, px double, py double")
    d = np.hypot(at[:, None, 0] - goal[None, :, 0], at[:, None, 1] - goal[None, :, 1])
    got = {r["pid"]: (r["poi"], r["dist"]) for r in S.nearest(pts, poi, "pid", "poi").collect()}
    assert got == {i: (int(np.argmin(row)), pytest.approx(row.min())) for i, row in enumerate(d)}
    for radius in (0.0, 0.4, 900.0, 1e6):
        n = {r["pid"]: r["n"] for r in S.count_within(pts, poi, "pid", radius).collect()}
        assert n == {i: int((row <= radius).sum()) for i, row in enumerate(d)}, radius
    p, q = (tree.build(x, tuple(F.col(c) for c in k)) for x, k in ((pts, ("x", "y", "x", "y")), (poi, ("px", "py", "px", "py"))))
    found = tree.nearest_leaves(p, q)
    # Nine tenths of the places lie in one metre, and a point meets on average the places of a dozen leaves.
    meets = found.others().groupBy("key").count().join(found.rows().groupBy("key").agg(F.count("*").alias("n")), "key").select((F.col("count") * F.col("n")).alias("m"))
    most, total = meets.select(F.max("m"), F.sum("m")).first()
    assert most <= tree.CAPACITY * 32 * 8 and total <= 2000 * 32 * 16, (most, total)
    assert found.split and found.rows().count() == 2000 and found.rows().select("pid").distinct().count() == 2000
    band = tree.leaves_within(p, q, 900.0).state.select(F.sum("inside"), F.max(F.size("nodes"))).first()
    assert band[0] > 0 and band[1] <= 8


def test_unknown_coordinates_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 0.0), (4, 5.0, 0.0), (5, 1.0, inf), (4, 5.0, 0.0)]
    pts = spark.createDataFrame(rows, "pid int, x double, y double")
    poi = spark.createDataFrame([(7, 1.0, 0.0), (8, None, 0.0), (9, 0.0, nan), (6, 1.0, 0.0)], "poi int, px double, py double")
    assert sorted(((r["pid"], r["poi"], r["dist"]) for r in S.nearest(pts, poi, "pid", "poi").collect())) == [(1, 6, 1.0), (2, None, None), (3, None, None), (4, 6, 4.0), (4, 6, 4.0), (5, None, None)]
    assert {r["pid"]: r["n"] for r in S.count_within(pts.filter("pid <> 4"), poi, "pid", 2.0).collect()} == {1: 2, 2: None, 3: None, 5: None}
    seg = spark.createDataFrame([(3.0, -1.0, 3.0, 1.0), (None, 0.0, 0.0, 0.0)], "ax double, ay double, bx double, by double")
    assert {r["pid"]: r["dist"] for r in S.nearest_line(pts, seg, "pid").collect()} == {1: 3.0, 2: None, 3: None, 4: 2.0, 5: None}
    o = pts.withColumn("budget", F.lit(10.0)).dropDuplicates(["pid"])
    homes = spark.createDataFrame([(0.0, 2.0, 9.0), (0.0, 1.0, 11.0), (None, 0.0, 1.0)], "px double, py double, rent double")
    assert {r["pid"]: (r["dist"], r["n"]) for r in S.nearest_within_budget(o.filter("pid IN (1, 2)"), homes, "pid").collect()} == {1: (2.0, 2), 2: (None, 2)}
    areas = pts.select(F.col("pid").alias("id"), "x", "y").dropDuplicates(["id"])
    assert sorted((r["i"], r["j"], r["w"]) for r in S.knn_weights(areas, 3).collect()) == [(1, 4, 1.0), (4, 1, 1.0)]
    ring = spark.createDataFrame([(1, [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]), (2, []), (3, None)], "unit int, ring array<struct<x:double,y:double>>")
    assert [(r["pid"], r["unit"]) for r in S.point_in_unit(pts, ring, "pid", "unit").collect()] == [(1, 1)]
    none = pts.limit(0)
    assert S.nearest(none, poi, "pid", "poi").count() == S.count_within(none, poi, "pid", 1.0).count() == S.nearest_line(none, seg, "pid").count() == 0
    assert {r["n"] for r in S.count_within(pts, poi.limit(0), "pid", 1.0).collect()} == {0, None}


def test_points_in_many_units_of_uneven_size(spark):
    rng = np.random.default_rng(5)
    at = uneven(rng, 1200)
    boxes = [(i, *c, *(c + rng.uniform(0.01, 0.2, 2))) for i, c in enumerate(rng.uniform(500, 501, (150, 2)))] + [(999, -50_000.0, -50_000.0, 50_000.0, 50_000.0)]
    rings = [(int(u), [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]) for u, a, b, c, d in boxes]
    units = spark.createDataFrame(rings, "unit int, ring array<struct<x:double,y:double>>")
    pts = frame(spark, [(i, *p) for i, p in enumerate(at)], "pid int, x double, y double")
    got = {r["pid"]: r["unit"] for r in S.point_in_unit(pts, units, "pid", "unit").collect()}
    inside = lambda p: [int(u) for u, a, b, c, d in boxes if a <= p[0] < c and b <= p[1] < d]
    assert got == {i: min(inside(p)) for i, p in enumerate(at) if inside(p)}

"""Hulls, outlines that touch, and fits with several effects, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import models as M
from hearthframe.operators import spatial as S


def test_convex_hull(spark):
    rng = np.random.default_rng(1)
    at = np.round(rng.normal(size=(400, 2)), 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in at] + [(None, 1.0), (float("nan"), 0.0)], "x double, y double").repartition(7)
    got = [(r["x"], r["y"]) for r in S.convex_hull(df).orderBy("ord").collect()]
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    n = len(got)
    assert n >= 3 and got[0] == min(got) and set(got) <= {tuple(p) for p in at.tolist()}
    assert all(turn(got[i], got[(i + 1) % n], got[(i + 2) % n]) > 0 for i in range(n))
    assert all(turn(got[i], got[(i + 1) % n], p) >= -1e-9 for i in range(n) for p in at.tolist())
    flat = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)] + [(0.0, 0.0)], "x double, y double")
    assert sorted((r["x"], r["y"]) for r in S.convex_hull(flat).collect()) == [(0.0, 0.0), (4.0, 8.0)]
    assert [(r["x"], r["y"]) for r in S.convex_hull(flat.limit(1)).collect()] == [(0.0, 0.0)] and S.convex_hull(flat.limit(0)).count() == 0


def test_hexagons_near_a_hull(spark):
    box = spark.createDataFrame([(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0), (500.0, 500.0)], "x double, y double")
    spots = [(1, 500.0, 500.0), (2, 1000.0 + 300 + 99, 500.0), (3, 1000.0 + 300 + 101, 500.0), (4, 500.0, -300 - 86.6), (5, 500.0, -300 - 86.7), (6, 1300.0, 1300.0), (7, 5000.0, 0.0)]
    hexes = spark.createDataFrame(spots, "hex_id int, x double, y double")
    got = {r["hex_id"] for r in S.keep_near_hull(hexes, box, "hex_id", 100.0, 300.0).collect()}
    corner = min(math.hypot(1300 + dx - 1000, 1300 + dy - 1000) for dx, dy in ((-100, 0), (-50, -86.6), (50, -86.6)))
    assert got == {1, 2, 4} | ({6} if corner <= 300 else set())
    assert S.keep_near_hull(hexes, box.limit(0), "hex_id", 100.0, 300.0).count() == 0
    huge = spark.createDataFrame([(1, 500.0, 500.0)], "hex_id int, x double, y double")
    assert S.keep_near_hull(huge, box, "hex_id", 1e6, 0.0).count() == 1  # the hull lies within the hexagon


def test_outlines_that_touch(spark):
    square = lambda x, y, s=1.0: [(float(a), float(b)) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    rings = [(1, square(0, 0)), (2, square(1, 1)), (3, square(1, 0.25, 0.5)), (4, [(5.0, 5.0), (6.0, 5.0), (5.5, 6.0)]), (5, square(-2, 0)), (6, None), (7, [])]
    df = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>")
    got = {(r["i"], r["j"]): r["w"] for r in S.ring_weights(df).collect()}
    assert got == {(1, 2): 0.5, (2, 1): 1.0, (1, 3): 0.5, (3, 1): 1.0}  # a shared corner; corners on another's edge


def test_several_effects_are_dummies(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, b, g = rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 25, n)
    x, z = rng.normal(size=n) + a, rng.normal(size=n)
    y = 0.7 * x - 0.2 * z + a**1.5 - b + 0.3 * rng.normal(size=n) + (g % 5) / 10
    rows = [(float(p), float(q), float(r), int(i), int(j), int(k)) for p, q, r, i, j, k in zip(y, x, z, a, b, g)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 0, 0, 0)], "y double, x double, z double, a int, b int, g int").repartition(3)
    got = {(r["spec"], r["term"]): r for r in M.specifications(df, "y", {"s": ["x"], "two": ["x"]}, ["z"], "g", effects={"two": ["a", "b"]})}
    full = np.c_[x, z, np.eye(6)[a], np.eye(4)[b][:, 1:]]
    inv = np.linalg.inv(full.T @ full)
    beta = inv @ full.T @ y
    e = y - full @ beta
    meat = sum(np.outer(s, s) for k in range(25) for s in [full[g == k].T @ e[g == k]])
    se = np.sqrt(np.diag(inv @ meat @ inv * (25 / 24) * ((n - 1) / (n - full.shape[1]))))
    assert got["two", "x"]["coef"] == pytest.approx(beta[0], abs=1e-8) and got["two", "x"]["se"] == pytest.approx(se[0], rel=1e-6) and got["two", "x"]["n"] == n
    plain = np.linalg.lstsq(np.c_[np.ones(n), x, z], y, rcond=None)[0]
    assert got["s", "x"]["coef"] == pytest.approx(plain[1])
    lone, taken = M.within(df, ["y"], ["a", "b"])
    assert taken == 9 and lone.groupBy("a").agg(F.abs(F.avg("y")).alias("m")).agg(F.max("m")).first()[0] < 1e-8
    rows = M.placebo_lines(df, "y", "x", ["z"], [], "g")
    assert rows[0]["coef_line"] == pytest.approx(plain[1]) and rows[0]["coef_other"] == pytest.approx(plain[2]) and 0 <= rows[0]["p_other"] <= 1

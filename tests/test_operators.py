"""Invariants of the operators that SQL can't express, and small stated cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.functions import finance as fin
from hearthframe.operators import duplicates as U
from hearthframe.operators import finance as N
from hearthframe.operators import graph as G
from hearthframe.operators import index as X
from hearthframe.operators import models as M
from hearthframe.operators import spatial as S


def test_normal_curve(spark):
    rows = spark.createDataFrame([(z,) for z in np.linspace(-5, 5, 41).tolist()], "z double").select("z", fin.phi(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 2e-7 for r in rows)
    back = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double").select("p", fin.phi(fin.phi_inverse(F.col("p"))).alias("q")).collect()
    assert all(abs(r["p"] - r["q"]) < 1e-6 for r in back)


def test_index_arithmetic(spark):
    r = spark.range(1).select(fin.monthly_payment(F.lit(470e6) * 0.7, 0.182933, 20).alias("p")).collect()[0]
    assert r["p"] == pytest.approx(5_151_869, rel=1e-4)
    assert 100 * 546_925.551 / (900_000 / 0.30) == pytest.approx(18.2309, abs=1e-4)


def test_value_capture_and_fares(spark):
    v = spark.createDataFrame([("m", 100.0)], "basis string, value double")
    assert N.value_capture(v, 10.0).count() == 9
    q = spark.createDataFrame([(k, 1531.449 * k**0.48319) for k in (5.0, 12.0, 30.0)], "km double, fare double")
    m = N.fare_model(q).collect()[0]
    assert (m["a"], m["b"]) == (pytest.approx(1531.449), pytest.approx(0.48319))


def test_mixture_quantile_inverts(spark):
    inc = spark.createDataFrame([("d", "s", 100.0, 50_000.0, 0.6, 1.0), ("d", "s", 300.0, 90_000.0, 0.8, 1.0), ("d", "t", 10.0, 20_000.0, 0.5, 1.0)], "district string, subcounty string, households double, income double, sigma double, nonhousing_min double")
    q = X.mixture_quantile(inc, 0.7, ("district",))
    back = X.mixture_shares(q, inc, ["level", "area"], {"s": F.col("quantile")}, ("district",)).collect()[0]
    assert back["s"] == pytest.approx(0.7, abs=1e-6)


def test_supply(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 150.0), (2, 0.0, 0.0, 600.0), (3, 0.0, 0.0, 50.0)], "oid int, x double, y double, budget double")
    q = spark.createDataFrame([(100.0, 0.0, 500.0), (900.0, 0.0, 100.0)], "px double, py double, rent double")
    got = {r["oid"]: (r["dist"], r["n"]) for r in S.nearest_within_budget(o, q, "oid").collect()}
    assert got == {1: (900.0, 1), 2: (100.0, 2), 3: (math.inf, 0)}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    p, q = rng.uniform(0, 5000, (60, 2)), rng.uniform(0, 5000, (25, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "pid int, x double, y double")
    poi = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "poi int, px double, py double")
    got = {r["pid"]: r["poi"] for r in S.nearest(pts, poi, "pid", "poi").collect()}
    assert got == {i: int(np.hypot(*(q - x).T).argmin()) for i, x in enumerate(p)}


def test_point_in_ring_and_lines(spark):
    tri = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])], "unit int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, -1.0, 1.0)], "pid int, x double, y double")
    assert [r["pid"] for r in S.point_in_unit(pts, tri, "pid", "unit").collect()] == [1]
    seg = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0)], "ax double, ay double, bx double, by double")
    assert S.nearest_line(pts.filter("pid = 2"), seg, "pid").collect()[0]["dist"] == 3.0


def test_shortest_times(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 9.0), ("c", "d", 100.0)], "u string, v string, minutes double")
    got = {r["node"]: r["minutes"] for r in G.shortest_times(G.both_ways(e), spark.createDataFrame([("a",)], "node string"), 60.0).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 3.0}


def test_similarity_and_clusters(spark):
    assert U.indel_ratio("", "") == 100 and U.indel_ratio("abc", "") == 0
    assert U.indel_ratio("abcd", "abxd") == pytest.approx(75)
    rows = spark.range(6).withColumnRenamed("id", "rid")
    edges = spark.createDataFrame([(5, 4), (4, 3), (1, 2)], "u bigint, v bigint")
    assert {r["rid"]: r["cluster"] for r in U.clusters(rows, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert {r["cluster"] for r in U.clusters(rows, edges.limit(0)).collect()} == set(range(6))


def test_gazetteer(spark):
    g = spark.createDataFrame([(0, "kisaasi", "Kisaasi"), (1, "ntinda", "Ntinda"), (2, "najjera", "Najjera"), (3, "kira_town", "Kira Town"), (4, "kira", "Kira")], "ord int, place string, name string")
    t = spark.createDataFrame([(1, "Kisaasi"), (2, "Standalone Kisaasi Road"), (3, "Najera"), (4, "Xyzzy Hill"), (5, "off Kira Town stage"), (6, None)], "tid int, text string")
    got = {r["tid"]: (r["place"], r["method"]) for r in U.match_place(t, g, "text", "tid").collect()}
    assert got == {1: ("kisaasi", "lookup_exact"), 2: ("kisaasi", "lookup_contains"), 3: ("najjera", "lookup_exact"), 4: (None, None), 5: ("kira_town", "lookup_contains"), 6: (None, None)}


def test_regression(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=400), rng.integers(0, 20, 400)
    y = 2 + 3 * x + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0) for a, b, c in zip(x, y, g)], "x double, y double, g int, one double")
    got = {r["term"]: r for r in M.ols_cluster(df, "y", ["one", "x"], "g")}
    design = np.c_[np.ones(400), x]
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    u = y - design @ b
    s = np.array([design[g == c].T @ u[g == c] for c in range(20)])
    inv = np.linalg.inv(design.T @ design)
    v = inv @ (s.T @ s) @ inv * (20 / 19) * (399 / 398)
    assert got["x"]["coef"] == pytest.approx(b[1]) and got["x"]["se"] == pytest.approx(np.sqrt(v[1, 1]))


def test_did_recovers_an_effect(spark):
    rng = np.random.default_rng(5)
    rows = [(p, post, int(p < 10), float(p + post + 0.5 * post * (p < 10) + 0.05 * rng.normal())) for p in range(20) for post in (0, 1) for _ in range(10)]
    df = spark.createDataFrame(rows, "point int, post int, treated int, y double")
    r = M.did_cluster(df, 199)
    assert r["coef"] == pytest.approx(0.5, abs=0.05) and r["p_boot"] < 0.05
    assert M.did_2x2(df).collect()[0]["did"] == pytest.approx(r["coef"], abs=1e-9)


def test_bootstrap_holds_the_median(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", None)], "g string, v double")
    got = {r["g"]: r for r in M.bootstrap_median(df, "g", "v").collect()}
    assert got["a"]["low"] <= got["a"]["median"] == 50 <= got["a"]["high"] and got["b"]["median"] is None


def test_local_regression(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(z), float(1 + 2 * z)) for i, (a, b, z) in enumerate(rng.uniform(0, 10, (200, 3)))]
    df = spark.createDataFrame(rows, "rid bigint, x double, y double, z double, t double")
    out = M.gwr(spark, df, "t", ["z"], 40).toPandas()
    assert np.allclose(out["b1"], 2) and np.allclose(out["b0"], 1, atol=1e-6)


def test_moran_ignores_scale(spark):
    v = spark.createDataFrame([(i, float(i % 5)) for i in range(25)], "id int, v double")
    a = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id int, x double, y double")
    w = S.knn_weights(a, 4)
    one, two = (S.moran_i(d, w).collect()[0]["moran"] for d in (v, v.withColumn("v", F.col("v") * 7 - 3)))
    assert one == pytest.approx(two) and one > 0.3


def test_local_permutation(spark):
    rng = np.random.default_rng(9)
    side = 7
    v = {(i, j): (10.0 if i < 3 and j < 3 else 0.0) + rng.normal(0, 0.1) for i in range(side) for j in range(side)}
    number = {c: k for k, c in enumerate(v)}
    values = spark.createDataFrame([(number[c], x) for c, x in v.items()] + [(99, None)], "id int, v double")
    pairs = [(number[a], number[b], 1.0) for a in v for b in v if a != b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1]
    weights = spark.createDataFrame(pairs + [(0, 99, 1.0)], "i int, j int, w double")
    got = {r["id"]: r for r in S.local_permutation(values, weights).collect()}
    assert set(got) == set(number.values())
    corner = got[number[1, 1]]
    assert corner["cluster"] == "High-High" and corner["p"] <= 0.01 and corner["gi"] > 3
    assert got[number[5, 5]]["quadrant"] == "LL" and sum(r["p"] < 0.05 for r in got.values()) < len(got)
    assert got == {r["id"]: r for r in S.local_permutation(values, weights).collect()}


def test_listing_links_against_plain(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, 12)) if i % 3 else rows[-1][9] + (" extra" if i % 2 else "") if rows else "x"
        rows.append((i, f"s{i % 2}", str(i % 90) if i % 7 else None, ["rent", "sale", None][i % 3 and i % 2], "house", None if i % 4 else 2, "kira", float(1000 + (i // 3) * 3), f"a{i % 5}", text))
    names = ["rid", "source", "source_id", "market", "ptype", "bedrooms", "place", "price", "agent", "txt"]
    df = spark.createDataFrame(rows, "rid int, source string, source_id string, market string, ptype string, bedrooms int, place string, price double, agent string, txt string")
    want = set()
    of = lambda r, *c: tuple(r[names.index(x)] for x in c)
    for a in rows:
        same = [b[0] for b in rows if None not in of(a, "source", "source_id") and of(b, "source", "source_id") == of(a, "source", "source_id")]
        if same and a[0] != min(same):
            want.add((min(same), a[0]))
        for b in rows:
            if of(a, "market", "ptype", "bedrooms", "place") != of(b, "market", "ptype", "bedrooms", "place") or not (b[7] > a[7] or b[7] == a[7] and b[0] > a[0]) or b[7] > a[7] * 1.005:
                continue
            ratio = U.indel_ratio(U.token_sort(a[9]), U.token_sort(b[9]))
            if ratio >= 88 or a[8] == b[8] and b[7] - a[7] <= 1e-3 * a[7] and ratio >= 60:
                want.add((a[0], b[0]))
    assert {(r["u"], r["v"]) for r in U.listing_links(df).collect()} == want and len(want) > 20


def test_features_and_design(spark):
    rows = [(i, "sale" if i % 2 else "rent", float(i % 5), None if i % 10 else 1.0, ["a", "b", None][i % 3], i % 2, 100.0 * i, 7.0, float(1 + i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, listing_type string, bedrooms double, rare double, kind string, f_pool int, x double, y double, plot_decimals double")
    d, names = M.feature_matrix(df, ["bedrooms", "rare", "absent"], ["kind"])
    assert names == ["bedrooms", "f_pool", "kind__a", "kind__b", "kind__missing", "x_km", "y_km"] and d.count() == 60
    assert d.agg(F.sum("kind__missing")).first()[0] == 20.0
    made, terms = M.price_design(df, "sale", ["f_pool", "rare"], ["x"], {"kind": "b"})
    assert terms == ["__one", "t_bedrooms", "t_bedrooms_squared", "t_log_plot", "t_log_x", "t_kind__1"] and made.count() == 20  # rows without a kind are left out
    assert "t_log_plot" not in M.price_design(df, "rent", [], [], {})[1]

"""Queries do the whole job: small tables against brute force in plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import models as M
from hearthframe.operators import spatial as S
from hearthframe.plans import models as PM
from hearthframe.sources.samples import VIEWS, view


def sorted_ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_links_compare_whole_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(200)]
    body = lambda: rng.sample(words, 50)
    one, header = body(), " ".join(words[:12])
    texts = [(" ".join(one), "s"), (" ".join(one[25:] + one[:25]), "t"), (header + " " + " ".join(body()), "s"), (header + " " + " ".join(body()), "t"), (header + " " + " ".join(body()), "s")]
    texts += [(" ".join(body()), rng.choice("st")) for _ in range(10)] + [("short", "s"), (None, "s"), (" ".join(one[:40] + body()[:10]), "s")]
    docs = [(i, t, s, "en", 400) for i, (t, s) in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars int")
    txt = [(t or "")[:400].lower() if len(t or "") >= 40 else s for t, s in texts]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if (r := sorted_ratio(txt[i], txt[j])) >= 88 or texts[i][1] == texts[j][1] and r >= 60}
    got = {(r["u"], r["v"]) for r in PM.dedup_edges(lambda _: df).collect()}
    assert got == want and (0, 1) in got and (2, 3) not in got
    clusters = {r["rid"]: r["cluster"] for r in PM.dup_components(lambda _: df).collect()}
    assert clusters[1] == 0 and len(clusters) == len(docs)
    kept = {r["cluster"]: r for r in PM.dedup_representatives(lambda _: df).collect()}
    assert set(kept) == set(clusters.values()) and kept[0]["n_portals"] == len({texts[i][1] for i, c in clusters.items() if c == 0})


def test_nearest_goes_on_to_the_last_point(spark):
    spots = [(1, 0.0, 0.0), (2, 40_000.0, 3.0), (3, -9e6, 7e6), (4, 11.0, 0.0)]
    pts, poi = spark.createDataFrame(spots, "pid int, x double, y double"), spark.createDataFrame([(7, 10.0, 0.0), (8, 12.0, 0.0)], "poi int, px double, py double")
    got = {r["pid"]: (r["poi"], r["dist"]) for r in S.nearest(pts, poi, "pid", "poi").collect()}
    assert got == {i: (p, pytest.approx(d)) for i, x, y in spots for d, p in [min((math.hypot(x - a, y), k) for k, a in ((7, 10.0), (8, 12.0)))]}
    with pytest.raises(ValueError):
        S.nearest(pts, poi.limit(0), "pid", "poi")


def test_searches_have_no_limit(spark):
    rng = np.random.default_rng(8)
    spots = [*rng.uniform(0, 3000, (40, 2)).tolist(), [250_000.0, -90_000.0], [-4e6, 10.0]]
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "pid int, x double, y double")
    ends = rng.uniform(0, 3000, (12, 4)).tolist() + [[9000.0, 9000.0, 9000.0, 9000.0]]
    seg = spark.createDataFrame(ends, "ax double, ay double, bx double, by double")

    def line(x, y, ax, ay, bx, by):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        k = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d)) if d else 0.0
        return math.hypot(ax + k * (bx - ax) - x, ay + k * (by - ay) - y)

    got = {r["pid"]: r["dist"] for r in S.nearest_line(pts, seg, "pid").collect()}
    assert got == {i: pytest.approx(min(line(x, y, *e) for e in ends)) for i, (x, y) in enumerate(spots)}
    assert [r["dist"] for r in S.nearest_line(pts.limit(2), seg.limit(0), "pid").collect()] == [None, None]
    homes = [(x, y, float(r)) for (x, y), r in zip(rng.uniform(0, 3000, (300, 2)).tolist(), rng.integers(1, 60, 300))]
    origins = [(i, x, y, float(b)) for i, ((x, y), b) in enumerate(zip(spots, rng.integers(0, 70, len(spots))))]
    rows = S.nearest_within_budget(spark.createDataFrame(origins, "oid int, x double, y double, budget double"), spark.createDataFrame(homes, "px double, py double, rent double"), "oid").collect()
    want = {i: ([math.hypot(x - h[0], y - h[1]) for h in homes if h[2] <= b]) for i, x, y, b in origins}
    assert {r["oid"]: (r["dist"], r["n"]) for r in rows} == {i: (pytest.approx(min(d, default=math.inf)), len(d)) for i, d in want.items()}


def grid(spark, sf_dir="/root/testdata/sf0.001"):
    return lambda name: view(spark, sf_dir, name)


def test_no_point_is_left_out(spark):
    from hearthframe.plans import places as PP
    from hearthframe.plans import spatial as PS

    t = grid(spark)
    points, poi = [r.asDict() for r in t("points").collect()], [r.asDict() for r in t("poi").collect()]
    away = lambda p, q: math.hypot(p["x"] - q["px"], p["y"] - q["py"])
    near = {r["pid"]: (r["poi"], r["dist"]) for r in PS.nearest_poi(t).collect()}
    assert near == {p["pid"]: (b[1], pytest.approx(b[0], abs=1e-5)) for p in points for b in [min((away(p, q), q["poi"]) for q in poi)]}
    assert {r["pid"]: r["n"] for r in PS.count_within(t).collect()} == {p["pid"]: sum(away(p, q) <= 1000 for q in poi) for p in points}
    assert {r["pid"] for r in PS.nearest_line(t).collect()} == set(near) == {r["pid"] for r in PP.covariates(t).collect()}


def test_local_regression_fits_every_point(spark):
    assert PM.gwr(grid(spark)).count() == grid(spark)("points").count() == 1500
    rng = np.random.default_rng(6)
    at = np.r_[rng.uniform(0, 10, (250, 2)), rng.uniform(5000, 5001, (30, 2)), [[-9e5, 4.0]]]
    z = rng.uniform(0, 1, len(at))
    y = np.sin(at[:, 0]) + z * at[:, 1] % 3
    got = M.gwr(spark, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.c_[at, z, y])], "rid bigint, x double, y double, z double, t double"), "t", ["z"], 40).toPandas().sort_values("rid")
    want = []
    for i, p in enumerate(at):
        d = np.hypot(*(at - p).T)
        h = np.sort(d)[40] + 1e-9
        w = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0)
        design = np.c_[np.ones(len(at)), z]
        want.append(np.linalg.lstsq((design * w[:, None]).T @ design, (design * w[:, None]).T @ y, rcond=None)[0])
    assert got["rid"].tolist() == list(range(len(at))) and np.allclose(got[["b0", "b1"]], want, atol=1e-6)


def test_roads_of_every_supplier(spark):
    import heapq

    from hearthframe.plans import spatial as PS

    s = spark.range(1, 301).select(F.col("id").cast("int").alias("s_suppkey"))
    t = {"supplier": s, "road_edges": spark.sql(VIEWS["road_edges"], supplier=s)}.get
    ways = {}
    for a in range(1, 301):
        for b in (a + 1, a + 7):
            for e in ((a, b), (b, a)):
                ways[e] = min(ways.get(e, math.inf), 1.0 + 13 * a % 9)
    assert {(r["u"], r["v"]): r["minutes"] for r in PS.road_edges(t).collect()} == ways
    kinds = {}
    for a in range(1, 301):
        for n in (a, a + 1, a + 7):
            kinds.setdefault(n, set()).add(a % 4)
    assert {r["node"] for r in PS.access_nodes(t).collect()} == {n for n, k in kinds.items() if 2 in k and len(k) > 1}
    best, heap = {}, [(0.0, 3)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best and d <= 30:
            best[n] = d
            for (u, v), m in ways.items():
                if u == n:
                    heapq.heappush(heap, (d + m, v))
    assert {r["node"]: r["minutes"] for r in PS.shortest_time(t).collect()} == best
    assert PS.cumulative_access(t).first().asDict() == {f"within_{m}": sum(2.0 * n for n, d in best.items() if d <= m and n <= 300) for m in (10, 20, 30)}


def test_whole_tables_are_read(spark):
    from hearthframe.plans import relational as PR

    few = spark.createDataFrame([(k, 150_000 + k if k else 1, dt.datetime(1995 + k % 4, 1 + k % 12, 9)) for k in (1, 50, 7, 13, 900_001, 1_200_002)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    months = spark.createDataFrame([(dt.date(1995, 1, 1), 1.0, 1), (dt.date(1998, 11, 1), 2.0, 1)], "month date, value double, n long")
    t = {"orders": few, "monthly": months}.get
    quarter = lambda d: dt.date(d.year, d.month - (d.month - 1) % 3, 1)
    days = {str(quarter(r["o_orderdate"]) + dt.timedelta(r["o_orderkey"] % 90)) for r in few.collect()}
    assert {r["day"] for r in PR.asof_nearest(t).collect()} == days
    codes = spark.range(1, 41).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").alias("o_orderdate"))
    assert {r["code"]: r["day"] for r in PR.code_date({"orders": codes}.get).collect()} == dict.fromkeys(range(1, 41), 9131.0)
    listings = spark.createDataFrame([(k, "3 bedroom house in KENYA for rent", 5) for k in (7, 900_000, 1_000_000, 6_000_000)], "lid long, title string, custkey long")
    assert {r["source_id"]: r["price_raw"] for r in PR.json_adverts({"listing_raw": listings}.get).collect()} == {"7": "70.0", "900000": "9000000.0", "1000000": "10000000.0", "6000000": "60000000.0"}
    region, nation = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "r_regionkey int, r_name string"), spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(7)], "n_nationkey int, n_name string, n_regionkey int")
    people = [(i, f"c{i}", i % 7) for i in (*range(1, 900), 99_999, 100_000, 250_000, 31_000_000)]
    got = PR.hierarchy_fill({"region": region, "nation": nation, "customer": spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int")}.get).collect()
    assert sorted(map(tuple, got)) == sorted((f"r{n % 3}", f"n{n}", c) for _, c, n in people)


def test_nulls_and_ties_keep_their_rows(spark):
    from hearthframe.operators import relational as R

    v = spark.createDataFrame([(i, x) for i, x in enumerate([None, 1.0, 2.0, 2.0, 9.0, 40.0, None])], "i int, v double")
    got = {r["i"]: r["v"] for r in R.winsorised(v, "v", 0.25, 0.75).collect()}
    lo, hi = np.percentile([1, 2, 2, 9, 40], [25, 75])
    assert got == {0: None, 1: lo, 2: 2.0, 3: 2.0, 4: 9.0, 5: hi, 6: None}
    assert [r["class"] for r in S.class_breaks(v, "v", 2).orderBy("i").collect()] == [None, 0, 0, 0, 1, 1, None]
    assert [r["bin"] for r in R.quantile_bins(v, "v", 2).orderBy("i").collect()] == [None, 1, 1, 1, 2, 2, None]
    nothing = v.limit(0)
    assert R.winsorised(nothing, "v", 0.1, 0.9).count() == 0 and [r["class"] for r in S.class_breaks(v.filter("v IS NULL"), "v", 3).collect()] == [None, None]
    day = dt.date
    left = spark.createDataFrame([(1, day(2020, 1, 5)), (1, day(2020, 1, 5)), (2, None), (3, day(1999, 1, 1))], "k int, at date")
    right = spark.createDataFrame([(day(2020, 1, 4), 1.0), (day(2020, 1, 6), 2.0), (None, 3.0)], "day date, value double")
    assert sorted((r["k"], r["value"]) for r in R.as_of_nearest(left, right, "at", "day", "value").collect() if r["k"] != 2) == [(1, 1.0), (1, 1.0), (3, 1.0)]
    assert [r["value"] for r in R.as_of_nearest(left, right, "at", "day", "value").filter("k = 2").collect()] == [None]
    assert [r["value"] for r in R.as_of_nearest(left, right.limit(0), "at", "day", "value").collect()] == [None] * 4


def test_quantiles_and_ranks_against_numpy(spark):
    from hearthframe.operators import relational as R

    rng = np.random.default_rng(2)
    x = np.r_[rng.integers(0, 40, 3000).astype(float), rng.normal(0, 1e6, 500)]
    df = spark.createDataFrame([(float(a),) for a in x], "v double")
    at = [0.0, 0.05, 0.5, 0.77, 0.95, 1.0]
    assert np.allclose(R.exact_quantiles(df, "v", at).first()["q"], np.percentile(x, [100 * a for a in at]))
    ranks = {r["v"]: (r["c"], r["below"]) for r in R.value_ranks(df, "v").collect()}
    assert ranks == {v: ((x == v).sum(), (x < v).sum()) for v in np.unique(x)}


def test_natural_breaks_are_the_best_cuts(spark):
    import itertools

    rng = np.random.default_rng(4)
    x = np.sort(np.r_[rng.normal(0, 1, 9), rng.normal(7, 1, 6), rng.normal(20, 2, 5)].round(2))
    spread = lambda part: ((part - part.mean()) ** 2).sum()
    best = min(itertools.combinations(range(1, len(x)), 2), key=lambda c: sum(spread(p) for p in np.split(x, c)))
    edges = S.class_edges(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 3, "fisher_jenks").first()["__e"]
    assert edges == [x[c - 1] for c in best]
    df = spark.createDataFrame([(-3.0,), (0.0,), (9.0,), (None,)], "v double")
    assert S.class_edges(df, "v", 4, "equal_interval").first()["__e"] == [0.0, 3.0, 6.0]
    assert S.class_edges(df, "v", 6, "symmetric").first()["__e"][2] == 0.0


def test_weights_of_near_areas(spark):
    rng = np.random.default_rng(3)
    at = np.r_[rng.uniform(0, 100, (40, 2)), [[9000.0, 9000.0]]]
    areas = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id int, x double, y double")
    got = {}
    for r in S.knn_weights(areas, 5).collect():
        got.setdefault(r["i"], set()).add(r["j"])
        assert r["w"] == 0.2
    assert got == {i: set(np.argsort(np.hypot(*(at - p).T))[1:6].tolist()) for i, p in enumerate(at)}
    assert S.knn_weights(areas.limit(1), 5).count() == 0 and S.knn_weights(areas.limit(3), 5).count() == 6


def test_streams_resume_and_take_empty_sources(spark, tmp_path):
    from hearthframe.streaming import snapshots as N

    schema = spark.createDataFrame([], "k string, at int, v double").schema
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    (tmp_path / "in").mkdir()
    source = lambda: N.file_stream(spark, folder, "*.parquet", schema)
    assert N.stream_latest(source(), ["k"], ["at"], root).count() == 0 and N.stream_first_seen(source(), ["k"], "at").count() == 0
    for n in range(10):
        spark.createDataFrame([("a", n, float(n)), (f"b{n % 3}", n, 0.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        last = {r["k"]: r["at"] for r in N.stream_latest(source(), ["k"], ["at"], root).collect()}
        assert last["a"] == n and last[f"b{n % 3}"] == n
    assert last == {"a": 9, "b0": 9, "b1": 7, "b2": 8}
    seen = {r["k"]: (r["first_seen"], r["n_postings"]) for r in N.stream_first_seen(source(), ["k"], "at").collect()}
    assert seen == {"a": (0, 10), "b0": (0, 4), "b1": (1, 3), "b2": (2, 3)}

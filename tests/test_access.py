"""Access for every origin: least times, components, snapping and shared-out amounts against plain versions."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from hearthframe.operators import graph as G


def grid_roads(n, rng):
    """Roads of a square grid, with random minutes and some parallel and missing ones."""
    at = lambda x, y: x * n + y
    roads = [(at(x, y), at(x + dx, y + dy), float(rng.randint(1, 6))) for x in range(n) for y in range(n) for dx, dy in ((1, 0), (0, 1)) if x + dx < n and y + dy < n and rng.random() < 0.85]
    return roads + [(u, v, m + 3) for u, v, m in roads[::5]]


def plain_times(roads, node, cutoff):
    ways = {}
    for u, v, m in roads:
        ways.setdefault(u, []).append((v, m))
        ways.setdefault(v, []).append((u, m))
    best, heap = {}, [(0.0, node)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best and d <= cutoff:
            best[x] = d
            for y, m in ways.get(x, []):
                heapq.heappush(heap, (d + m, y))
    return best


def edges(spark, roads):
    return G.both_ways(spark.createDataFrame(roads, "u bigint, v bigint, minutes double"))


def test_times_of_many_origins_at_once(spark):
    rng = random.Random(2)
    roads = grid_roads(7, rng)
    origins = [(i, rng.randrange(49)) for i in range(12)] + [(50, None), (51, 777), (0, 0)]
    got = {}
    for r in G.times_from_each(edges(spark, [*roads, (None, 3, 1.0), (3, None, 1.0), (1, 2, None)]), spark.createDataFrame(origins, "origin int, node bigint"), 11.0).collect():
        got.setdefault(r["origin"], {})[r["node"]] = r["minutes"]
    want = {i: plain_times(roads, n, 11.0) for i, n in origins if n is not None}
    first = want[0], plain_times(roads, origins[0][1], 11.0)
    want[0] = {n: min(f.get(n, math.inf) for f in first) for n in first[0] | first[1]}
    assert got == want
    none = spark.createDataFrame([], "origin int, node bigint")
    assert G.times_from_each(edges(spark, roads), none, 5.0).count() == 0
    with pytest.raises(RuntimeError):
        G.times_from_each(edges(spark, [(i, i + 1, 1.0) for i in range(9)]), spark.createDataFrame([(1, 0)], "origin int, node bigint"), 60.0, most_rounds=4)


def test_only_the_largest_component_stays(spark):
    roads = [(1, 2, 1.0), (2, 3, 1.0), (10, 11, 1.0), (11, 12, 2.0), (12, 10, 3.0), (20, 21, 1.0)]
    got = sorted((r["u"], r["v"]) for r in G.largest_component(edges(spark, roads)).collect())
    assert got == sorted(x for u, v, _ in roads[:2] for x in ((u, v), (v, u)))
    assert G.largest_component(edges(spark, roads).limit(0)).count() == 0


def test_access_is_a_row_an_origin(spark):
    rng = random.Random(4)
    roads = grid_roads(5, rng)
    nodes = spark.createDataFrame([(i, 300.0 * (i // 5), 300.0 * (i % 5)) for i in range(25)], "node bigint, x double, y double")
    spots = [(i, rng.uniform(0, 1200), rng.uniform(0, 1200)) for i in range(8)] + [(90, 9e6, 0.0), (91, None, 4.0)]
    squares = [(c, rng.uniform(0, 1200), rng.uniform(0, 1200), rng.choice(["p", "q", None]), float(rng.randrange(9)), None if c == 3 else float(rng.randrange(4))) for c in range(40)]
    origins = G.snap(spark.createDataFrame(spots, "origin int, x double, y double"), nodes, "origin", 4.0)
    cells = spark.createDataFrame(squares, "cell int, x double, y double, unit string, lit double, built double")
    totals = spark.createDataFrame([("p", 100.0), ("q", 50.0), ("r", 7.0)], "unit string, total double")
    shared = G.spread_amounts(cells, totals, {"by_lit": F.col("lit"), "by_mix": F.sqrt(F.col("lit") * F.col("built"))})
    placed = G.snap(cells, nodes, "cell", 4.0).join(shared.drop("x", "y"), "cell")
    times = G.times_from_each(edges(spark, roads), origins, 30.0)
    got = {r["origin"]: r.asDict() for r in G.access_by_origin(times, origins, placed, ["lit", "by_lit", "by_mix"], (10, 20, 30)).collect()}

    def near(x, y):
        d, n = min((math.hypot(x - 300.0 * (i // 5), y - 300.0 * (i % 5)), i) for i in range(25))
        return n, d / 1000 / 4 * 60

    weigh = {"by_lit": lambda c: c[4], "by_mix": lambda c: math.sqrt(c[4] * c[5]) if c[5] is not None else 0.0}
    sums = {(k, u): sum(w(c) for c in squares if c[3] == u) for k, w in weigh.items() for u in "pq"}
    share = lambda k, c: {"p": 100.0, "q": 50.0}[c[3]] * weigh[k](c) / sums[k, c[3]] if c[3] and sums[k, c[3]] else 0.0
    assert set(got) == {s[0] for s in spots}
    for i, x, y in spots:
        if x is None:
            assert got[i]["access"] is None and got[i]["lit_30"] == 0.0
            continue
        n, out = near(x, y)
        way = plain_times(roads, n, 30.0)
        assert got[i]["access"] == pytest.approx(out)
        for m in (10, 20, 30):
            reached = [c for c in squares if (k := near(c[1], c[2])) and k[0] in way and way[k[0]] + out + k[1] <= m]
            assert got[i][f"lit_{m}"] == pytest.approx(sum(c[4] for c in reached))
            for k in weigh:
                assert got[i][f"{k}_{m}"] == pytest.approx(sum(share(k, c) for c in reached))

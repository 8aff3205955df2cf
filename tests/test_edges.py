"""Unknown, undefined and constant values: null where nothing can be said, and never a crash."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import models as M
from hearthframe.operators import relational as R
from hearthframe.operators import spatial as S

NAN = float("nan")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_values_that_are_not_there_take_no_part(spark):
    v = frame(spark, [(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (5, NAN), (6, 9.0)], "id int, v double")
    # Unit 1 neighbours all others, unit 6 none that counts, units 3 and 5 have no value.
    w = frame(spark, [(1, j, 0.2) for j in (2, 3, 4, 5, 6)] + [(2, 1, 0.5), (2, 4, 0.5), (4, 2, 1.0), (3, 1, 1.0), (6, 5, 1.0)], "i int, j int, w double")
    got = {r["id"]: r for r in S.local_moran(v, w).collect()}
    x = {1: 1.0, 2: 2.0, 4: 4.0, 6: 9.0}
    m, s = np.mean(list(x.values())), np.std(list(x.values()))
    z = {k: (a - m) / s for k, a in x.items()}
    lag = {1: 0.2 * (z[2] + z[4] + z[6]), 2: 0.5 * (z[1] + z[4]), 4: z[2]}
    assert set(got) == set(lag) and all(got[k]["local_i"] == pytest.approx(z[k] * lag[k]) for k in lag)
    assert {got[k]["quadrant"] for k in lag} <= {"HH", "LL", "HL", "LH"} and S.moran_i(v, w).first()["n"] == 3
    gi = {r["id"]: r["gi"] for r in S.gi_star(v, w).collect()}
    assert set(gi) == set(x) and gi[1] is None  # it neighbours all that have a value
    assert gi[4] == pytest.approx((6.0 - 2 * m) / (s * np.sqrt((4 * 2 - 4) / 3)))
    same = frame(spark, [(i, 3.0) for i in range(4)], "id int, v double")
    ring = frame(spark, [(i, (i + 1) % 4, 1.0) for i in range(4)], "i int, j int, w double")
    assert {(r["local_i"], r["quadrant"]) for r in S.local_moran(same, ring).collect()} == {(None, None)} and S.moran_i(same, ring).first()["moran"] is None
    assert {r["gi"] for r in S.gi_star(same, ring).collect()} == {None}
    for none in (same, v.limit(0), v.filter("v IS NULL")):
        assert M.moran_permutation(none, ring, 9) == {"moran": None, "p": None, "z": None}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_keyed_permutations_move_every_number_once(n):
    x = np.arange(n)
    drawn = [M.shuffled(x, n, d, 7) for d in range(1, 6)]
    assert all(sorted(p.tolist()) == x.tolist() for p in drawn)
    assert n < 16 or len({tuple(p.tolist()) for p in drawn}) == 5
    if n == 1000:
        assert abs(np.corrcoef(x, drawn[0])[0, 1]) < 0.1 and (drawn[0][::7] == M.shuffled(x[::7], n, 1, 7)).all()


def test_moran_permutation_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30) + np.arange(30) / 5
    edges = [(i, j, 0.5) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30]
    v = frame(spark, [(i, float(a)) for i, a in enumerate(x)] + [(90, None), (91, NAN)], "id int, v double").repartition(3)
    w = frame(spark, edges + [(90, 1, 1.0), (1, 91, 1.0)], "i int, j int, w double")
    got = M.moran_permutation(v, w, 99, 5, lot=40)
    z = (x - x.mean()) / x.std()
    i, j, u = (np.array([e[k] for e in edges]) for k in range(3))
    stat = lambda z: float((u * z[i] * z[j]).sum() / u.sum())
    sims = []
    for d in range(1, 100):
        put = np.empty(30)
        put[M.shuffled(np.arange(30), 30, d, 5)] = z
        sims.append(stat(put))
    sims = np.array(sims)
    observed = stat(z)
    p = ((np.abs(sims - sims.mean()) >= abs(observed - sims.mean())).sum() + 1) / 100
    assert got["moran"] == pytest.approx(observed) and got["p"] == pytest.approx(p) and got["z"] == pytest.approx((observed - sims.mean()) / sims.std())
    assert got["p"] == 0.01  # neighbours are alike
    noise = M.moran_permutation(frame(spark, [(i, float(a)) for i, a in enumerate(rng.permutation(x))], "id int, v double"), w, 99, 5)
    assert noise["p"] > 0.05


def test_series_without_a_link_or_a_start(spark):
    old, new = frame(spark, [("a", 2.0), ("b", 4.0)], "m string, v double"), frame(spark, [("b", 8.0), ("c", 9.0)], "m string, v double")
    rows = lambda d: {r["m"]: r["v"] for r in d.collect()}
    assert rows(R.splice(old, new, "m", "v", "b")) == {"a": 4.0, "b": 8.0, "c": 9.0}
    assert rows(R.splice(old, new, "m", "v", "zz")) == {"a": None, "b": 8.0, "c": 9.0}
    assert rows(R.splice(old.replace(4.0, 0.0), new, "m", "v", "b")) == {"a": None, "b": 8.0, "c": 9.0}
    day = lambda y: dt.date(y, 1, 1)
    g = lambda x: R.growth(frame(spark, x, "d date, v double"), "d", "v", 1).first()
    assert tuple(g([(day(2000), 0.0), (day(2002), 0.0), (day(2004), 5.0)])) == (None, None)
    assert tuple(g([(day(2000), 3.0)])) == (None, None) and g([(day(2000), 1.0), (day(2004), 16.0)])["cagr"] == pytest.approx(1.0, abs=1e-3)
    v = frame(spark, [(1, 1.0), (2, NAN), (3, 5.0), (4, None), (5, 9.0)], "i int, v double")
    assert {r["i"]: r["v"] for r in R.winsorised(v, "v", 0.25, 0.75).collect()} == {1: 3.0, 2: None, 3: 5.0, 4: None, 5: 7.0}


def test_fits_of_one_cluster_and_constant_targets(spark):
    one = frame(spark, [(1.0, float(i), 2.0 * i + i % 2, "c") for i in range(6)], "k double, x double, y double, g string")
    got = M.ols_cluster(one, "y", ["k", "x"], "g")
    assert got[1]["coef"] == pytest.approx(np.polyfit(range(6), [2.0 * i + i % 2 for i in range(6)], 1)[0]) and {(r["se"], r["t"]) for r in got} == {(None, None)}
    r = M.cv_metrics(frame(spark, [("a", 2.0, 1.0), ("a", 2.0, 2.0)], "g string, y double, p double"), ["g"], "y", "p").first()
    assert r["r2"] is None and r["mae"] == 0.5


def test_running_shares_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(1, 9, 200), rng.uniform(0, 5, 200)))]
    df = frame(spark, rows, "i int, w double, v double").repartition(5)
    got = {r["i"]: (r["x"], r["y"]) for r in R.concentration(df, "w", "v", ["i"]).collect()}
    w, v = (np.cumsum([r[k] for r in rows]) / sum(r[k] for r in rows) for k in (1, 2))
    assert got == {i: (pytest.approx(w[i]), pytest.approx(v[i])) for i in range(200)}
    assert sorted((r["i"], r["number"]) for r in R.numbered(df, ["i"]).collect()) == [(i, i) for i in range(200)]
    c = R.concentration_index(R.concentration(df, "w", "v", ["i"])).first()
    x, y = np.r_[0, w], np.r_[0, v]
    assert c["c"] == pytest.approx(1 - ((x[1:] - x[:-1]) * (y[1:] + y[:-1])).sum()) and c["bottom50"] == pytest.approx(np.interp(0.5, x, y)) and c["top20"] == pytest.approx(1 - np.interp(0.8, x, y))
    assert R.concentration(df.limit(0), "w", "v", ["i"]).count() == 0

"""Explanations, clustered inference, local regression and study designs against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import explain as E
from hearthframe.operators import models as M


def frame(spark, names, rows):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names))


def test_leaf_values_match_all_subsets():
    rng = np.random.default_rng(2)
    tree = [(3.0, [(0, -np.inf, 0.5, 0.6)]), (-1.0, [(0, 0.5, np.inf, 0.4), (1, -np.inf, 0.2, 0.25)]), (2.0, [(0, 0.5, np.inf, 0.4), (1, 0.2, np.inf, 0.75), (2, 0.1, 0.9, 0.3)]), (5.0, [])]
    x = rng.uniform(0, 1, (40, 4))

    def pays(row, known):
        return sum(v * math.prod(float(a < row[f] <= b) if f in known else z for f, a, b, z in path) for v, path in tree)

    got, base = E.shapley(x, tree)
    assert base == pytest.approx(pays(x[0], ()))
    for row, mine in zip(x, got):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (pays(row, (*s, i)) - pays(row, s)) for n in range(4) for s in itertools.combinations(rest, n))
            assert mine[i] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("boosted", [False, True])
def test_explanations_add_up_to_the_prediction(spark, boosted):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (300, 3))
    df = frame(spark, ["a", "b", "c", "y"], np.c_[x, 3 * x[:, 0] + (x[:, 1] > 0.5)]).selectExpr("CASE WHEN a < 0.05 THEN NULL ELSE a END AS a", "b", "c", "CASE WHEN c < 0.02 THEN NULL ELSE y END AS y", "a AS score")
    got = E.explained(df, ["a", "b", "c"], "y", 4, boosted=boosted).toPandas()
    assert len(got) == 300 and np.allclose(got["base"] + got[["s_a", "s_b", "s_c"]].sum(axis=1), got["prediction"], atol=1e-9)
    assert got["s_a"].abs().mean() > got["s_b"].abs().mean() > got["s_c"].abs().mean()


def plain_did(rows, columns):
    """Least squares with point dummies; coefficients and CR1 errors of the columns times post."""
    point, post, y = (np.array([r[i] for r in rows], float) for i in range(3))
    points = sorted(set(point))
    x = np.c_[np.array([[r[3 + c] * r[1] for c in range(columns)] for r in rows], float), post, np.array([[p == q for q in points] for p in point], float)]
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    u = y - x @ b
    scores = [x[point == p].T @ u[point == p] for p in points]
    v = inv @ sum(np.outer(s, s) for s in scores) @ inv
    g, n = len(points), len(rows)
    return b[:columns], np.sqrt(np.diag(v)[:columns] * g / (g - 1) * (n - 1) / (n - columns - 1 - g))


def test_differences_of_several_treatments(spark):
    rng = np.random.default_rng(1)
    rows = [(p, q, 1 + p / 9 + 0.4 * q + 0.8 * q * (p % 3 == 0) + rng.normal(0, 0.3), float(p % 3 == 0), float(p % 4 == 1)) for p in range(14) for q in (0, 1) for _ in range(6 + p % 4)]
    df = frame(spark, ["point", "post", "y", "one", "two"], rows)
    got = M.did_fit(df, ["one", "two"], 499)
    b, se = plain_did(rows, 2)
    assert [r["coef"] for r in got] == pytest.approx(b.tolist()) and [r["se"] for r in got] == pytest.approx(se.tolist())
    assert got[0]["p_boot"] < 0.05 < got[1]["p_boot"] and [r["treated_points"] for r in got] == [5, 4] and got[0]["points"] == 14
    assert M.did_fit(df.repartition(5), ["one", "two"], 499)[1]["p_boot"] == pytest.approx(got[1]["p_boot"])


def test_checks_and_specifications(spark):
    rng = np.random.default_rng(3)
    rows = [(p, q, 0.5 * q * (p <= 12) + rng.normal(0, 0.2), float(p), float((p * 7) % 29), float(rng.integers(0, 2))) for p in range(1, 30) for q in (0, 1) for _ in range(4)]
    df = frame(spark, ["point", "post", "y", "minutes", "other", "z"], rows)
    got = M.did_checks(df, "minutes", placebos=("other",), subsets={"z only": df["z"] > 0}, draws=19)
    by = {(r["check"], r["treatment"]): r for r in got}
    assert set(by) == {(f"limit {v}", f"near_{v}") for v in (10, 20, 25)} | {("dose", "band_0_15"), ("dose", "band_15_30"), ("placebo other", "placebo_other"), ("trimmed", "near_15"), ("z only", "near_15")}
    assert by["limit 10", "near_10"]["coef"] > 0.3 and abs(by["placebo other", "placebo_other"]["coef"]) < 0.2
    assert by["z only", "near_15"]["n"] == sum(r[5] > 0 for r in rows) and by["trimmed", "near_15"]["n"] < len(rows)
    specs = M.specifications(df, "y", {"time": ["minutes"], "both": ["minutes", "other"]}, ["post"], "point", ("z",))
    assert [(r["spec"], r["further"], r["term"]) for r in specs] == [("time", False, "minutes"), ("time", True, "minutes"), ("time", True, "z"), ("both", False, "minutes"), ("both", False, "other"), ("both", True, "minutes"), ("both", True, "other"), ("both", True, "z")]
    x = np.array([[1, r[3], r[1]] for r in rows])
    assert specs[0]["coef"] == pytest.approx(np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0][1])


def plain_local(at, design, y, k):
    """Fitted values and the hat matrix of local regressions at every point."""
    hat = np.zeros((len(at), len(at)))
    for i, p in enumerate(at):
        d = np.hypot(*(at - p).T)
        w = np.where(d < (h := np.sort(d)[k] + 1e-9), (1 - (d / h) ** 2) ** 2, 0.0)
        xw = design * w[:, None]
        hat[i] = design[i] @ np.linalg.pinv(xw.T @ design) @ xw.T
    return hat @ y, hat


def test_local_regression_leverage_bandwidth_and_prediction(spark):
    rng = np.random.default_rng(9)
    at, z = rng.uniform(0, 100, (90, 2)), rng.normal(0, 1, 90)
    y = np.sin(at[:, 0] / 20) + 0.5 * z + rng.normal(0, 0.1, 90)
    df = frame(spark, ["rid", "x", "y", "z", "t"], np.c_[np.arange(90), at, z, y])
    fits = M.gwr(spark, df, "t", ["z"], 25)
    want, hat = plain_local(at, np.c_[np.ones(90), z], y, 25)
    got = fits.toPandas().sort_values("rid")
    assert np.allclose(got["fitted"], want) and np.allclose(got["leverage"], np.diag(hat)) and np.allclose(got["residual"], y - want)
    rss, trace = ((y - want) ** 2).sum(), np.trace(hat)
    score = M.gwr_score(fits)
    assert score["trace"] == pytest.approx(trace) and score["aicc"] == pytest.approx(90 * np.log(2 * np.pi * rss / 90) + 90 + 180 * (trace + 1) / (88 - trace))
    tests = M.gwr_tests(fits, 2).toPandas()
    assert tests["sig1"].all() and np.allclose(tests["t1"], tests["b1"] / np.sqrt(tests["c1"] * rss / (90 - trace)))
    tried = M.gwr_bandwidth(spark, df, "t", ["z"], 10, 24)
    assert tried[0]["aicc"] == min(r["aicc"] for r in tried) and all(10 <= r["neighbours"] <= 24 for r in tried) and len(tried) >= 4
    new = frame(spark, ["rid", "x", "y", "z"], [(0, 50.0, 50.0, 0.3), (1, 1e6, 3.0, 0.0)])
    there = {r["rid"]: r for r in M.gwr(spark, df, "t", ["z"], 25, at=new).collect()}
    d = np.hypot(*(at - [50, 50]).T)
    w = np.where(d < (h := np.sort(d)[24] + 1e-9), (1 - (d / h) ** 2) ** 2, 0.0)
    b = np.linalg.lstsq(np.c_[w, w * z].T @ np.c_[np.ones(90), z], np.c_[w, w * z].T @ y, rcond=None)[0]
    assert there[0]["fitted"] == pytest.approx(b @ [1, 0.3]) and there[0]["residual"] is None and len(there) == 2


def test_cross_validation_schemes(spark):
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 90, (120, 2))
    df = frame(spark, ["id", "x", "y", "z", "t"], np.c_[np.arange(120), at, rng.normal(0, 1, 120), np.sin(at[:, 0] / 9)]).selectExpr("*", "CAST(floor(x / 30) AS STRING) AS block")
    got = {(r["scheme"], r["model"]): r for r in M.cv_schemes(df, ["x", "z"], "t", "id", "block", 3, 3, 20).collect()}
    assert set(got) == {(s, m) for s in ("block", "random") for m in ("forest", "linear", "local")} and all(r["n"] == 120 for r in got.values())
    assert got["random", "forest"]["rmse"] < got["block", "forest"]["rmse"]
    folds = M.random_folds(df, "id", 3)
    assert sorted(map(tuple, folds.select("id", "fold").collect())) == sorted(map(tuple, M.random_folds(df.repartition(3), "id", 3).select("id", "fold").collect()))


def test_variants_of_a_sample(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "s string, v int")
    got = M.variants(df, {"all": F.lit(True), "not a": F.col("s") != "a", "known": F.col("v").isNotNull(), "none": F.lit(False)}).groupBy("variant").count().collect()
    assert {r["variant"]: r["count"] for r in got} == {"all": 3, "not a": 1, "known": 2}


def test_rows_of_one_large_block_stay_in_many_tasks(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("block"), F.col("id").cast("double").alias("x")).repartition(4)
    parts = [len(p) for p in M.block_folds(df, "block", 2).select("id").rdd.glom().collect()]
    assert sum(parts) == 4000 and max(parts) <= 1000


def test_boosted_trees_do_not_depend_on_the_layout_of_rows(spark):
    # More training rows than the learner takes to find its splits, so it samples them.
    df = spark.range(30_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7).alias("x"), (F.col("id") % 2).cast("int").alias("fold")).withColumn("ly", F.sin("x") + F.col("x") / 500)
    one, many = ({r["id"]: r["prediction"] for r in M.forest_cv(df.repartition(n, "id"), ["x"], "ly", "fold", 2, boosted=True).collect()} for n in (1, 7))
    assert len(one) == 30_000 and one.keys() == many.keys()
    assert max(abs(one[i] - many[i]) for i in one) < 1e-9


def test_training_rows_go_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 500)
    df = spark.range(4000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("ly")).coalesce(1)
    parts = [len(p) for p in M.dealt(df, ["x", "ly"], 4000).rdd.glom().collect()]
    assert len(parts) == 8 and sum(parts) == 4000 and max(parts) < 650

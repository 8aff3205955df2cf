"""Bootstraps and quantiles of groups that no task holds: against plain resampling and plain bisection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.operators import duplicates as U
from hearthframe.operators import index as X
from hearthframe.operators import models as M


def test_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 500)] + [("b", float(v)) for v in rng.normal(size=300)] + [("c", 4.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    ranks = M._by_rank(df, "k", "x")
    asked = spark.createDataFrame([("a", r) for r in range(0, 500, 7)] + [("b", r) for r in (0, 150, 299)] + [("c", 0)], "g string, rank bigint")
    x = {g: np.sort([v for k, v in rows if k == g and v is not None]) for g in "abc"}
    for parts in (3, 1024):
        assert {(r["g"], r["rank"]): r["v"] for r in M.values_at(ranks, asked, parts).collect()} == {(r["g"], r["rank"]): x[r["g"]][r["rank"]] for r in asked.collect()}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 301, 400])
def test_bootstrap_of_the_median_is_resampling(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(size=n), 3)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", None)], "k string, x double").repartition(3)
    got = {r["k"]: r for r in M.bootstrap_median(df, "k", "x", 4000).collect()}
    assert tuple(got["b"])[1:] == (None, None, None) and got["a"]["median"] == pytest.approx(np.median(x))
    sims = np.sort(np.median(rng.choice(x, (20_000, n)), axis=1))
    # The ends lie where plain resampling has 2.5 and 97.5 in a hundred, give or take one in a hundred.
    for end, at in (("low", 0.025), ("high", 0.975)):
        lo, hi = np.quantile(sims, [max(0, at - 0.01), min(1, at + 0.01)])
        assert lo - 1e-9 <= got["a"][end] <= hi + 1e-9, (n, end)


def test_a_large_group_is_many_tasks(spark):
    df = spark.range(400_000).select(F.lit(1).alias("k"), (F.xxhash64("id") % 100_003).cast("double").alias("x"))
    ranks = M._by_rank(df, "k", "x")
    sizes = [len(p) for p in ranks.select("below").rdd.glom().collect()]
    assert sum(sizes) > 150_000
    got = M.bootstrap_median(df, "k", "x", 200).first()
    assert got["low"] < got["median"] < got["high"] and got["high"] - got["low"] < 2000


def test_precision_falls_with_size(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(g, float(v)) for g, n in (("a", 700), ("b", 25)) for v in rng.lognormal(1, 0.4, n)], "k string, x double")
    got = {(r["k"], r["size"]): r["half_width"] for r in M.precision_curve(df, "k", "x").collect()}
    assert set(got) == {("a", s) for s in (10, 20, 40, 80)} | {("b", 10), ("b", 20)}
    curve = [got["a", s] for s in (10, 20, 40, 80)]
    assert curve == sorted(curve, reverse=True)
    x = rng.lognormal(1, 0.4, 700)
    plain = np.mean([(np.percentile(m, 97.5) - np.percentile(m, 2.5)) / 2 / np.median(s) for s in (rng.choice(x, 40, replace=False) for _ in range(60)) for m in [np.median(rng.choice(s, (200, 40)), axis=1)]])
    assert got["a", 40] == pytest.approx(plain, rel=0.3)


def test_mixture_quantile_against_bisection(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.uniform(5e4, 1e6)), float(rng.integers(20, 400)), 0.34 + 0.02 * (i % 3), f"d{i % 2}", f"s{i % 5}", float(rng.uniform(0.4, 0.9))) for i in range(60)]
    df = spark.createDataFrame(rows, "parish int, income double, households double, gini double, district string, subcounty string, sigma double").repartition(4)
    got = {(r["level"], r["area"]): r["quantile"] for r in X.mixture_quantile(df, 0.4).collect()}
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for d in ("d0", "d1"):
        mine = [r for r in rows if r[4] == d]
        a, b = 0.0, 30.0
        for _ in range(80):
            mid = (a + b) / 2
            if sum(r[2] * phi((mid - math.log(r[1])) / r[6]) for r in mine) < 0.4 * sum(r[2] for r in mine):
                a = mid
            else:
                b = mid
        key = next(k for k in got if k[1] == d)
        assert got[key] == pytest.approx(math.exp(a), rel=1e-6)


def listings(spark, n, groups, seed=6):
    rng = np.random.default_rng(seed)
    words = ["plot", "house", "lake", "view", "gated", "tiled", "quiet", "ready", "title", "bedroom"]
    pool = [" ".join(rng.choice(words, 9)) for _ in range(12)]
    pool += [p[:-3] + "xyz" for p in pool[:6]]
    rows = [
        (i, "alpha", str(int(rng.integers(0, groups))) if rng.random() < 0.7 else None, "sale", "house", None, "p", float(round(100 * (1 + 0.004 * rng.integers(0, 40)) * (1 + rng.choice([0, 0.0005])), 3)), rng.choice(["a1", "a2", "a3"]) if rng.random() < 0.8 else None, str(rng.choice(pool)))
        for i in rng.permutation(n).tolist()
    ]
    return spark.createDataFrame(rows, "rid long, source string, source_id string, market string, ptype string, bedrooms string, place string, price double, agent string, txt string").repartition(3)


@pytest.mark.parametrize("n,groups,most", [(60, 5000, 16384), (900, 5000, 16384), (900, 5000, 100), (900, 300, 16384)])
def test_ties_make_the_classes_of_all_links(spark, monkeypatch, n, groups, most):
    monkeypatch.setattr(U, "TIE_ROWS", most)
    rows = listings(spark, n, groups)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    every = U.listing_links(rows).collect()
    for r in every:
        a, b = root(r["u"]), root(r["v"])
        up[max(a, b)] = min(a, b)
    got = {r["rid"]: r["cluster"] for r in U.listing_clusters(rows).collect()}
    assert got == {i: root(i) for i in range(n)} and 1 < len(set(got.values())) < n


def test_copies_make_ties_not_pairs(spark):
    df = spark.range(2000).select(F.col("id").alias("rid"), F.lit("p").alias("place"), F.lit(100.0).alias("price"), F.lit("a").alias("agent"), F.lit("house with a view").alias("words"))
    assert U.ties(df, ["place"]).count() == 1999  # two million links


def test_long_chains_of_links_settle_in_few_rounds(spark):
    order = np.random.default_rng(2).permutation(600).tolist()
    rows = spark.createDataFrame([(i,) for i in order], "rid long")
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert {r["cluster"] for r in U.clusters(rows, edges, most_rounds=14).collect()} == {0}


@pytest.mark.parametrize("query", ["dup_components", "dedup_representatives"])
def test_classes_of_copies_need_few_links(spark, monkeypatch, query):
    from hearthframe.plans import models as PM

    made, plain = [], U._labels
    monkeypatch.setattr(U, "_labels", lambda edges, *a: made.append(edges.count()) or plain(edges, *a))
    texts = ["the same long text of a posting, number one " * 3, "another posting that is unlike it, two " * 4]
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("text"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.lit("en").alias("lang"), F.lit(150).alias("n_chars"))
    got = getattr(PM, query)(lambda _: docs).collect()
    assert {r["cluster"] for r in got} == {0, 1} and len(got) == (600 if query == "dup_components" else 2)
    assert made == [598]  # 89,700 links

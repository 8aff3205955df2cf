"""The n-gram join, components and neighbours against brute force; the pipeline's stages in order."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import neighbours, ngram_join
from hearthframe.llm.common import Scratch
from hearthframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for _ in range(rng.choice([1, 2, 5, 14])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(60)] + passage) for _ in range(30)]
    rows += ["", None, "one two", "one two", "One, two!", "a b c d e", "a b c d f", "x " * 40_000, "x " * 40_001]
    rows += rows[:5]
    return [(i if i % 9 else None, t) for i, t in enumerate(rows)] + [(3, rows[3]), (3, rows[3])]


def brute(rows, similarity=0.8):
    shingle = ngram_join.Shingler()
    distinct = list(dict.fromkeys((t or "") for _, t in rows))
    sets = [set(shingle(t).tolist()) for t in distinct]
    parent = list(range(len(distinct)))
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    at = {t: i for i, t in enumerate(distinct)}
    least = {}
    for d, t in rows:
        c = find(at[t or ""])
        if d is not None:
            least[c] = min(least.get(c, d), d)
    copies = Counter(t or "" for _, t in rows)
    return Counter((d, least.get(find(at[t or ""])), links[at[t or ""]], copies[t or ""]) for d, t in rows)


@pytest.mark.parametrize("limits", [{}, {"leaders": 3, "chunk": 10, "block": 4}])
def test_join_against_brute_force(spark, limits):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.join(df, **limits).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute(rows)
    assert ngram_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"leaders": 16, "chunk": 64}])
def test_pairs_inside_a_large_family(spark, limits):
    """Texts that share half their words by a common passage, and pairs among them just above the threshold."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(130)]
    rows = []
    for _ in range(250):
        own = [word() for _ in range(100)]
        rows.append(" ".join(passage + own))
        if len(rows) < 200:
            own[40:40] = [word() for _ in range(rng.randrange(38, 52))]
            rows.append(" ".join(passage + own))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = ngram_join.join(df, **limits).collect()
    want = brute(list(enumerate(rows)))
    assert sum(n for (_, _, n, _) in want.elements()) >= 100
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == want


def test_one_of_each_class_stays(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    kept = ngram_join.stage(spark, df, "")
    assert kept.columns == df.columns
    classes = {r.class_id for r in ngram_join.join(df.select("doc_id", "text")).collect()}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for c in classes if c is not None}


def test_runs_follow_the_recall():
    assert ngram_join.runs_for(0.5) <= ngram_join.runs_for(0.99) <= ngram_join.runs_for(0.999999)


def test_hilbert_steps_are_single():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(neighbours.hilbert_keys(g, 3))
    assert (np.abs(np.diff(g[order], axis=0)).sum(axis=1) == 1).all()


def nearest_by_scan(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) of rows (vec_id, vector), in plain Python order of summing."""
    want = []
    for at, (i, q) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum_in_order(q, v), j) for o, (j, v) in enumerate(rows) if o != at]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(want)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))


@pytest.mark.parametrize("block", [64, 256, 2048])
def test_exact_search_against_brute_force(spark, block):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 16))
    x[50:80] = x[40]  # equal vectors
    x[300:310] = -np.abs(x[300:310])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[40], rows[41], (60, rows[7][1]), (20, rows[9][1])]  # a repeated row of a query, and ids of several vectors
    got = sorted(tuple(r) for r in neighbours.search(frame(spark, rows), block=block, recall=1).collect())
    assert got == nearest_by_scan(rows)


@pytest.mark.parametrize("block", [64, 256])
def test_windows_alone_reach_the_recall(spark, block):
    rng = np.random.default_rng(5)
    even = rng.normal(size=(3000, 32))
    clustered = rng.normal(size=(60, 32))[rng.integers(0, 60, 3000)] * 3 + rng.normal(size=(3000, 32)) * 0.2
    for x in (even, clustered):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = {}
        for r in neighbours.search(frame(spark, list(enumerate(x))), block=block).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        share = []
        for i in range(0, 3000, 20):
            s = x @ x[i]
            s[i] = -9
            share.append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
            assert len(got[i]) == 20 and i not in got[i]
        assert np.mean(share) >= 0.9


def test_one_common_vector_and_negative_products(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 5001)] + [(0, [-1.0, 0.0]), (6000, [0.0, -1.0])]
    got = {}
    for r in neighbours.search(frame(spark, rows), block=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 6000, 0.0)] + [(r, r - 1, -1.0) for r in range(2, 21)]
    assert sorted(got[20]) == [(r, r if r < 20 else 21, 1.0) for r in range(1, 21)]
    assert sorted(got[4000]) == [(r, r, 1.0) for r in range(1, 21)]
    assert len(got) == 252


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in neighbours.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns)
    assert out.count() > 50 and out.filter("shard NOT BETWEEN 0 AND 23").count() == 0
    assert out.select(F.max("slot")).collect()[0][0] is not None

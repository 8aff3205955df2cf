"""The pipeline stage by stage against a plain run: only the toxicity scores are taken from the operator."""

import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from hearthframe.llm import mixing, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def one_of_each_class(rows):
    """Of the rows whose five-word shingles have a Jaccard similarity of 0.8 or more, directly or by others, that of the least id."""
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i]["text"] == rows[j]["text"] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == least[find(i)]]


def clean(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    kept = []
    for r in rows:
        w, hit = words(r["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def mixed(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    taken = {i: (n, s) for i, s, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall()}
    out = []
    for r in rows:
        n, size = taken[r["doc_id"]]
        if size:
            out += [(r["doc_id"], r["text"])] * (n // size)
            if n % size:
                out.append((r["doc_id"], r["text"][: list(GAP.finditer(r["text"]))[n % size - 1].end()]))
    return out


def jump(key, shards):
    key, at, after = key % 2**64, -1, 0
    while after < shards:
        at = after
        key = (key * 2862933555777941757 + 1) % 2**64
        after = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_every_stage_takes_effect(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"  # in the smallest tables no document is toxic
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]).collect()}
    start = [r.asDict() for r in docs.collect()]
    fit = [r for r in start if scores[r["doc_id"]] < toxicity.CUT]
    single = one_of_each_class(fit)
    kept = clean(single, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    want = mixed(kept)
    assert len(start) > len(fit) > len(single) >= len(kept) > 0
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(want)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"score": F.lit("mine"), "node": F.lit(7), "__row": F.lit(True), "size": F.col("doc_id") * 2})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "benchmark_decontamination":
            docs = docs.drop("__row")
        got = stage(spark, docs.limit(60), sf_dir)
        assert got.columns == docs.columns, name
        assert all(r["score"] == "mine" and r["node"] == 7 and r["size"] == 2 * r["doc_id"] for r in got.collect()), name

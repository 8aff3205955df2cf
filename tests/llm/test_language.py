"""Language identification: letter runs and judgements against plain versions, clusters, rejection, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "sho"], "bb": ["gra", "stu", "blö", "ngt", "erz"], "cc": ["que", "lio", "ñan", "dos", "vía"]}


def made(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def plain_runs(text, bits, longest):
    """Counts of letter runs, with runs of other characters as one space and a space before the text."""
    s = " "
    for ch in text.lower():
        s += ch if ch.isalpha() else ("" if s[-1] == " " else " ")
    out = np.zeros(1 << bits, int)
    for n in range(1, longest + 1):
        for i in range(max(1, n - 1), len(s)):
            h = 2166136261 + n
            for ch in s[i - n + 1 : i + 1]:
                h = (h ^ ord(ch)) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            out[h >> (32 - bits)] += 1
    return out


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 20])
def test_letter_runs_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("aBé .1ñ\n") for _ in range(rng.randrange(1, 60)))
        got = L.run_counts(text, 10)
        if any(c.isalpha() for c in text):
            assert (got == plain_runs(text, 10, 3)).all()
        else:
            assert got is None
    assert L.run_counts(None) is None and L.run_counts("12 !?") is None


def test_clusters_of_two_kinds_of_text():
    rng = np.random.default_rng(2)
    base = np.eye(3, 30)
    x = L.unit(np.concatenate([base[i] + 0.05 * rng.random((40, 30)) for i in range(3)]))
    c = L.cluster(x, 3)
    own = (x @ c.T).argmax(axis=1).reshape(3, 40)
    assert len(c) == 3 and all(len(set(o)) == 1 for o in own) and len({o[0] for o in own}) == 3
    assert len(L.cluster(x[:1], 4)) == 1 and len(L.cluster(np.repeat(x[:1], 9, axis=0), 4)) == 1


def test_languages_rejection_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, made(lang, rng, 40), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa", "x"), (901, "123", "bb", "x"), (902, "ka to mi", None, "x"), (None, "zz zz", "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    model = L.train(docs, most_rows=50, bits=12)
    assert model.names == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    asked = [(1, made("bb", rng, 30)), (2, None), (3, ""), (4, "12:30 !"), (5, "жёщ фъи цщэ"), (6, made("cc", rng, 20000)), (1, made("bb", rng, 30))]
    got = L.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), model, ["doc_id"]).collect()
    assert [g.lang_pred for g in got[:4]] == ["bb", "und", "und", "und"] and got[5].lang_pred == "cc" and got[6].lang_pred == "bb"
    assert got[4].rejected and not got[0].rejected and not got[1].rejected and got[1].score == 0.0
    assert all(0 <= g.score <= 1 for g in got)
    for row, (_, text) in zip(got, asked):  # the nearest centroid, one vector at a time
        counts = L.run_counts(text, 12)
        if counts is not None:
            v = np.log1p(counts) * model.idf
            cosine = [float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for c in model.centroids]
            assert row.lang_pred == model.names[model.owner[int(np.argmax(cosine))]] and abs(row.score - max(cosine)) < 1e-4


def test_sample_is_bounded_by_language_and_nothing_learned_gives_und(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "aa" if i % 10 else "bb") for i in range(3000)], "doc_id bigint, text string, lang string")
    n = {r.lang: r.n for r in L.teaching_sample(docs, 100).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert n == {"aa": 100, "bb": 100}
    none = L.train(docs.limit(0), bits=8)
    assert [r.lang_pred for r in L.identify(docs.limit(2), none, ["doc_id"]).collect()] == ["und", "und"]
    assert L.identify(docs.limit(0), none, ["doc_id"]).count() == 0


def test_query_of_the_contract(spark):
    from hearthframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_centroid_language"](spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)

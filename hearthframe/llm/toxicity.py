"""Toxicity by a factorization machine over hashed terms (Rendle, 2010).

A text is the set of its hashed terms. The score is w0 + sum w_i + sum over pairs <v_i, v_j>, so a pair such as an
insult and a group's name can weigh more than its parts. The pair sum costs one pass over the terms.

Learning: a bounded sample of labelled rows (``most_rows``, smallest hash of doc_id within each label; documented and
by default 12,000), whose term ids, not texts, go to four tasks, one for each machine of the fit (three cross-fitted
ones and that of all rows); the driver sees margins and the telling terms' weights. Scoring: whole texts of any length, in Arrow batches, with the
fixed-size weights in the task closure. Null and empty texts get the score of no terms. Repeated rows score alike.
Repeated labels of one doc_id count as toxic if any does; null labels or ids teach nothing. With one class only, or an
empty table of labels, all scores are that class's rate. An empty table gives an empty result. Columns of the input may
bear any name, ``score`` too: the stage carries them apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, only, table, text_or_empty

BITS = 18
FACTORS = 4
EPOCHS = 12
MOST_ROWS = 12000
SEED = 7
FOLDS = 3
CUT = 0.3
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class TermHasher:
    """Distinct hashed terms of a text: its words and their beginnings of 5 and 7 letters. Remembers a bounded number of words."""

    def __init__(self, bits: int = BITS, remember: int = 100_000):
        mask = (1 << bits) - 1

        def made(w: bytes) -> tuple[int, ...]:
            word = w.decode("utf-8", "replace")
            return (zlib.crc32(w) & mask, *(zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) & mask for n in (5, 7) if len(word) > n))

        self.known = Remembered(made, remember)

    def __call__(self, text: str | None) -> np.ndarray:
        words = set((text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split())
        return np.unique(np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int64))


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        return float(self.margins([ids])[0])

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """Margins of several texts in one pass over all their terms."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.full(len(texts), float(self.bias))
        some = np.flatnonzero(lengths)
        if len(some):
            ids = np.concatenate([texts[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
            v = self.factors[ids].astype(np.float64)
            s, squares = np.add.reduceat(v, starts, axis=0), np.add.reduceat((v * v).sum(axis=1), starts)
            out[some] += np.add.reduceat(self.linear[ids].astype(np.float64), starts) + 0.5 * ((s * s).sum(axis=1) - squares)
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))

    def score(self, ids: np.ndarray) -> float:
        return float(self.scores([ids])[0])

    def thin(self) -> "FactorizationMachine":
        """With 32-bit weights, to be sent to the tasks."""
        return FactorizationMachine(self.bias, self.linear.astype(np.float32), self.factors.astype(np.float32), self.slope, self.shift)


def telling_terms(terms: list[np.ndarray], labels: np.ndarray, size: int, least_z: float = 3.0) -> np.ndarray:
    """Booleans by term: seen in at least three texts, and its log odds ratio is least_z standard errors from 0."""
    pos, neg = np.zeros(size), np.zeros(size)
    for t, y in zip(terms, labels):
        (pos if y == 1 else neg)[t] += 1
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    a, b, c, d = pos + 0.5, neg + 0.5, n1 - pos + 0.5, n0 - neg + 0.5
    z = (np.log(a * d) - np.log(b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return (pos + neg >= 3) & (np.abs(z) >= least_z)


def telling_pairs(terms: list[np.ndarray], labels: np.ndarray, size: int, telling: np.ndarray) -> np.ndarray:
    """Booleans by term: one of a pair whose texts' labels differ from what both terms tell by themselves.

    A pair of terms, not both telling, is tested in all texts that hold both: under the share expected from each term's
    odds, the chance of the share seen (Chernoff's bound) is at most 0.01 by the number of all pairs. Tested are pairs in
    as many texts as two neutral terms need to pass if all those texts have the rarer label, whose share counts as at
    most 0.4. Terms that are in the same texts are tested once.
    """
    n, share = len(labels), float(labels.mean())
    if share in (0.0, 1.0):
        return np.zeros(size, bool)
    low = min(share, 1 - share, 0.4)
    limit = float(np.log(size * size / 2 / 0.01))
    least = int(np.ceil(limit / np.log(1 / low)))
    lengths = np.fromiter((len(t) for t in terms), np.int64, n)
    ids, rows = np.concatenate(terms), np.repeat(np.arange(n, dtype=np.int32), lengths)
    often = np.bincount(ids, minlength=size) >= least
    rows, ids = rows[often[ids]], ids[often[ids]]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    names, starts = np.unique(ids, return_index=True)
    groups: dict[bytes, list[int]] = {}
    for t, r in zip(names, np.split(rows, starts[1:])):
        groups.setdefault(r.tobytes(), []).append(int(t))
    ranked = sorted(groups.items(), key=lambda g: -len(g[0]))  # commonest first: each pair is counted from its rarer term
    held, members = [np.frombuffer(k, np.int32) for k, _ in ranked], [v for _, v in ranked]
    one = labels == 1
    n1 = float(one.sum())
    all_of = np.array([len(r) for r in held], np.float64)
    pos_of = np.array([one[r].sum() for r in held], np.float64)
    base = np.log(n1 / (n - n1))
    odds = np.log((pos_of + 0.5) / (all_of - pos_of + 0.5)) - base
    told = np.array([telling[m[0]] for m in members], bool)
    flat = np.concatenate([np.empty(0, np.int32), *held])
    ends = np.cumsum(np.bincount(flat, minlength=n))[:-1]
    texts = np.split(np.repeat(np.arange(len(held), dtype=np.int32), all_of.astype(np.int64))[np.argsort(flat, kind="stable")], ends)
    found = np.zeros(len(held), bool)
    nothing = np.empty(0, np.int32)
    for a in range(1, len(held)):
        hits, others = (np.bincount(np.concatenate([nothing, *[texts[r] for r in held[a][one[held[a]] == v]]]), minlength=a)[:a] for v in (True, False))
        b = np.flatnonzero((hits + others >= least) & ~(told[:a] & told[a]))
        if not len(b):
            continue
        m = (hits[b] + others[b]).astype(np.float64)
        seen, raw = hits[b] / m, 1 / (1 + np.exp(-np.clip(base + odds[a] + odds[b], -30, 30)))
        p = np.clip(raw, 0.01, 0.99)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(seen > 0, seen * np.log(seen / p), 0.0) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / (1 - p)), 0.0)
        gap[((raw <= 0.01) & (seen <= 0.01)) | ((raw >= 0.99) & (seen >= 0.99))] = 0.0
        new = b[m * gap >= limit]
        if len(new):
            found[a] = found[new] = True
    out = np.zeros(size, bool)
    for k in np.flatnonzero(found):
        out[members[k]] = True
    return out


def descend(terms: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, size: int, factors: int, epochs: int, l2: float, rate: float, seed: int) -> FactorizationMachine:
    """AdaGrad on the weighted logistic loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(size), rng.normal(0, 0.01, (size, factors)), 0.0
    v[np.bincount(np.concatenate(terms), minlength=size) == 0] = 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    n = len(labels)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 64):
            rows = order[a : a + 64]
            ids = np.concatenate([terms[i] for i in rows])
            lengths = np.fromiter((len(terms[i]) for i in rows), np.int64, len(rows))
            row = np.repeat(np.arange(len(rows)), lengths)
            vi = v[ids]
            sums = np.zeros((len(rows), factors))
            np.add.at(sums, row, vi)
            squares = np.bincount(row, (vi * vi).sum(axis=1), len(rows))
            margin = b + np.bincount(row, w[ids], len(rows)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, error[row], len(used)) + l2 * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, place, error[row][:, None] * (sums[row] - vi))
            dv += l2 * 4 * v[used]
            db = error.sum()
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += db * db
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.1 * dv / np.sqrt(gv[used])
            b -= rate * db / np.sqrt(gb)
    return FactorizationMachine(b, w, v)


def fit(terms: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, l2: float = 3e-4, rate: float = 0.1, seed: int = SEED, prior: float | None = None) -> FactorizationMachine:
    """The machine on terms that tell alone or in a pair, calibrated on margins of cross-fitted machines.

    prior: share of label 1 among all labelled rows, where the sample has another.
    """
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        return only_rate(share, bits)
    made = [machine(k, terms, labels, bits, factors, epochs, l2, rate, seed) for k in range(FOLDS + 1)]
    return calibrated(made[-1][0], [m[1:] for m in made[:-1]], prior)


def only_rate(share: float, bits: int, factors: int = FACTORS) -> FactorizationMachine:
    """The machine that gives every text one label's rate."""
    p = min(max(share, 1e-3), 1 - 1e-3)
    return FactorizationMachine(float(np.log(p / (1 - p))), np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32))


def machine(k: int, terms: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, l2: float = 3e-4, rate: float = 0.1, seed: int = SEED) -> tuple[FactorizationMachine, np.ndarray, np.ndarray, np.ndarray]:
    """The k-th machine of a fit, and place, margin and label of the rows it did not see; the last one (k = FOLDS) sees all."""
    size = 1 << bits
    distinct = {t.tobytes() + bytes([int(y)]): i for i, (t, y) in enumerate(zip(terms, labels))}
    kept = sorted(distinct.values())  # copies teach once
    del distinct
    terms, labels = [terms[i] for i in kept], labels[kept]
    part = np.random.default_rng(seed).permutation(len(labels)) % FOLDS
    rows, away = np.flatnonzero(part != k), np.flatnonzero(part == k)
    mine, y = [terms[i] for i in rows], labels[rows]
    telling = telling_terms(mine, y, size)
    telling |= telling_pairs(mine, y, size, telling)
    mine = [t[telling[t]] for t in mine]
    s = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    fm = descend(mine, y, np.where(y == 1, 0.5 / s, 0.5 / (1 - s)), size, factors, epochs, l2, rate, seed)
    fm.linear[~telling] = 0.0
    fm.factors[~telling] = 0.0
    return fm, away, np.array([fm.margin(terms[i]) for i in away], np.float64), labels[away]


def calibrated(fm: FactorizationMachine, unseen: list[tuple[np.ndarray, np.ndarray, np.ndarray]], prior: float | None) -> FactorizationMachine:
    """The machine of all rows with slope and shift from (place, margin, label) of rows that each machine did not see."""
    place, margins, labels = (np.concatenate(c) for c in zip(*unseen))
    order = np.argsort(place)
    margins, labels = margins[order], labels[order]
    share = float(labels.mean())
    prior = share if prior is None else prior
    fm.slope, fm.shift = platt(margins, labels, np.where(labels == 1, prior / share, (1 - prior) / (1 - share)))
    return fm


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through weighted (margin, label) points, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def with_held_out(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows that may teach."""
    rows = only(labels, doc_id="doc_id", label=label).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return rows.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held).groupBy("doc_id").agg(F.max("label").alias("label"))


def teaching_rows(docs: DataFrame, taught: DataFrame, most_rows: int, smaller: int = 1) -> DataFrame:
    """At most most_rows // 2 of each label, those of smallest hashed id: the same sample in every run."""
    hashed = taught.withColumn("__h", F.xxhash64(F.col("doc_id"), F.lit(SEED)))
    half = most_rows // 2
    chosen = hashed.filter(F.col("label") == smaller).orderBy("__h").limit(half).unionByName(hashed.filter(F.col("label") != smaller).orderBy("__h").limit(half))
    return docs.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # at most most_rows rows of two numbers


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most_rows: int = MOST_ROWS, bits: int = BITS) -> FactorizationMachine:
    taught = with_held_out(labels, label, folds, held)
    chosen = teaching_rows(only(docs, doc_id="doc_id", text="text"), taught, most_rows)

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = TermHasher(bits)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "terms": [hasher(t).astype(np.int32).tobytes() for t in f["text"]]})

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        rows = group.sort_values(["doc_id", "label", "terms"])
        y = rows["label"].to_numpy(np.float64)
        share = float(y.mean())
        if share in (0.0, 1.0):
            return pd.DataFrame({"k": [k], "share": [share], "bias": [None], "ids": [[]], "weights": [[]], "place": [[]], "margin": [[]], "y": [[]]})
        fm, place, margin, label = machine(k, [np.frombuffer(t, np.int32) for t in rows["terms"]], y, bits)
        ids = np.flatnonzero((fm.linear != 0) | (fm.factors != 0).any(axis=1)) if k == FOLDS else np.empty(0, np.int64)
        weights = np.c_[fm.linear[ids], fm.factors[ids]].ravel()
        return pd.DataFrame({"k": [k], "share": [share], "bias": [float(fm.bias)], "ids": [ids], "weights": [weights], "place": [place], "margin": [margin], "y": [label]})

    # Each of the four tasks gets the bounded sample; named numbers of tasks are not joined to fewer by size.
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = chosen.mapInPandas(terms, "doc_id long, label int, terms binary").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    made = rows.repartition(tasks, "k").groupBy("k").applyInPandas(fitted, "k int, share double, bias double, ids array<long>, weights array<double>, place array<long>, margin array<double>, y array<double>")
    got = sorted(made.collect(), key=lambda r: r["k"])  # four rows: margins of the sample, weights of its telling terms
    if not got or got[0]["bias"] is None:
        return only_rate(got[0]["share"] if got else 0.0, bits)
    fm = FactorizationMachine(got[-1]["bias"], np.zeros(1 << bits), np.zeros((1 << bits, FACTORS)))
    weights = np.array(got[-1]["weights"]).reshape(-1, 1 + FACTORS)
    fm.linear[got[-1]["ids"]], fm.factors[got[-1]["ids"]] = weights[:, 0], weights[:, 1:]
    counts = {int(r["label"]): int(r["count"]) for r in taught.groupBy("label").count().collect()}  # a row for each label
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return calibrated(fm, [(np.array(r["place"], np.int64), np.array(r["margin"]), np.array(r["y"])) for r in got[:-1]], prior).thin()


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str], bits: int = BITS, text: str = "text") -> DataFrame:
    """The kept columns and ``score``; no shuffle. ``text`` may be among the kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**bits * (factors + 1) floats

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, fm = TermHasher(bits), shared.value
        for texts in batches:
            made = [fm.scores([hasher(t) for t in texts.iloc[a : a + 256]]) for a in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate([np.empty(0), *made]), dtype="float64")

    return docs.select(*keep, scored(text_or_empty(text)).alias("score"))


def op4_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    scored = score(only(docs, doc_id="doc_id", text="text"), model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    kept = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"), model, ["__row"]).filter(F.col("score") < CUT)
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])

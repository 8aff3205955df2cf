"""Language identification by the nearest of several centroids a language.

A text is a vector over hashed runs of one to three letters (word ends count as a letter): logarithmic counts times inverse
document frequencies, of length 1. Each language's vectors are clustered (spherical k-means), so that a language of several
kinds of text has several centroids; a text takes the language of the centroid of greatest cosine. A text whose distance from
it exceeds the language's threshold, fitted on texts that made no centroid, is marked as rejected.

Learning uses a bounded, documented sample: of each language at most ``most_rows`` rows (least hash of the id), read whole;
copies teach once, null texts, labels and ids nothing. Each language is clustered in a task of its own, over at most that many
vectors. Scoring reads whole texts of any length, a million letters at a time, against centroids of fixed size.

A null text, and one without a letter, is ``und`` with score 0 and not rejected; without any learned language all are. Ties go to
the language first in order. Repeated rows score alike. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table

BITS = 14
LONGEST = 3
CENTROIDS = 4
ROUNDS = 12
MOST_ROWS = 1500
#: A text is rejected if it is farther than SLACK times the distance that this share of the language's own texts lies within.
WITHIN, SLACK = 0.995, 1.25
PIECE = 1 << 20
LOT = 64
SEED = 11
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def run_counts(text: str | None, bits: int = BITS, longest: int = LONGEST) -> np.ndarray | None:
    """Counts of the hashed letter runs of a whole text; None if it has no letter."""
    if not text:
        return None
    total, seen = np.zeros(1 << bits, np.int64), False
    last = np.full(1, 32, np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[points]
        seen = seen or bool(is_letter.any())
        points = np.where(is_letter, points, np.uint32(32))
        kept = np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])
        points = points[kept]
        if last[-1] == 32 and points[0] == 32:  # a seam in a run of other characters
            points = points[1:]
        joined = np.concatenate([last, points])
        fresh = len(last)
        for n in range(1, longest + 1):
            # runs of n letters that end in this piece
            ends = np.arange(max(fresh, n - 1), len(joined))
            if not len(ends):
                continue
            h = np.full(len(ends), 2166136261 + n, np.uint32)
            for k in range(n - 1, -1, -1):
                h = (h ^ joined[ends - k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            total += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
        last = joined[-(longest - 1) :] if longest > 1 else joined[-1:]
    return total if seen else None


@dataclass
class LanguageModel:
    """Centroids of length 1, a row each, with the language and the greatest distance that is not rejected."""

    names: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    threshold: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        return unit(np.log1p(np.stack(counts)).astype(np.float32) * self.idf)

    def judge(self, counts: list[np.ndarray | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        names, score, rejected = [UNKNOWN] * len(counts), np.zeros(len(counts)), np.zeros(len(counts), bool)
        some = [i for i, c in enumerate(counts) if c is not None]
        if some and self.names:
            cosine = self.vectors([counts[i] for i in some]) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, c, s in zip(some, best.tolist(), cosine[np.arange(len(some)), best].tolist()):
                names[i] = self.names[self.owner[c]]
                score[i] = min(1.0, max(0.0, s))
                rejected[i] = 1.0 - s > self.threshold[self.owner[c]]
        return names, score, rejected


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means of rows of length 1: at most k centroids of length 1, fewer for fewer rows. Starts are rows far from those before."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        gap = 1 - np.max(x @ np.stack(centres).T, axis=1)
        if gap.max() < 1e-6:
            break
        centres.append(x[rng.choice(len(x), p=np.maximum(gap, 0) / np.maximum(gap, 0).sum())])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def teaching_sample(docs: DataFrame, most_rows: int, seed: int = SEED) -> DataFrame:
    """(lang, text, part) of at most ``most_rows`` rows a language, by least hash of the id; ``part`` is a number from 0 to 9 by text."""
    able = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").withColumn("lot", F.xxhash64("doc_id", F.lit(seed)))
    sizes = able.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # a row a language
    # A little over the share that gives most_rows, so that little is shuffled for the exact cut after it.
    share = F.least(F.lit(1.0), (1.2 * most_rows + 200) / F.col("rows"))
    near = able.join(F.broadcast(sizes), "lang").filter((F.pmod("lot", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("lot", F.lit(1 << 30)), "lot", "doc_id", F.xxhash64("text")))
    return near.withColumn("place", place).filter(F.col("place") <= most_rows).select("lang", "text", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(10)).alias("part"))


def train(docs: DataFrame, most_rows: int = MOST_ROWS, centroids: int = CENTROIDS, bits: int = BITS, within: float = WITHIN) -> LanguageModel:
    """A model of rows (doc_id, text, lang)."""
    spark = docs.sparkSession
    size = 1 << bits

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, parts = batch.columns
            for i in range(batch.num_rows):
                counts = run_counts(texts[i].as_py(), bits)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([langs.slice(i, 1), parts.slice(i, 1), pa.array([at], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int32()))], names=["lang", "part", "at", "n"])

    scratch = Scratch(spark, "language")
    sample = teaching_sample(only(docs, doc_id="doc_id", text="text", lang="lang"), most_rows).dropDuplicates(["lang", "text"])
    kept = scratch.write(sample.mapInArrow(vectors, "lang string, part bigint, at array<int>, n array<int>"), "vectors")
    seen = {r["at"]: r["n"] for r in kept.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^bits rows
    rows = kept.count()
    df = np.zeros(size)
    df[list(seen)] = list(seen.values())
    idf = (np.log((1 + rows) / (1 + df)) + 0.05).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), size), np.float32)  # at most most_rows vectors
        for i, (at, n) in enumerate(zip(group["at"], group["n"])):
            x[i, at] = np.log1p(n)
        x = unit(x * shared.value)
        held = (group["part"] >= 8).to_numpy()
        if held.all() or not held.any():
            held = np.zeros(len(group), bool)
        c = cluster(x[~held], centroids)
        gaps = 1 - ((x[held] if held.any() else x) @ c.T).max(axis=1)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [row.tolist() for row in c], "threshold": SLACK * float(np.quantile(gaps, within))})

    found = kept.groupBy("lang").applyInPandas(fitted, "lang string, centroid array<float>, threshold double").orderBy("lang", F.hash("centroid")).collect()  # centroids of fixed size a language
    scratch.drop("vectors")
    names = sorted({r["lang"] for r in found})
    if not names:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, size), np.float32), np.zeros(0), idf)
    by_name = {r["lang"]: r["threshold"] for r in found}
    return LanguageModel(names, np.array([names.index(r["lang"]) for r in found]), np.array([r["centroid"] for r in found], np.float32), np.array([by_name[n] for n in names]), idf)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of fixed size a language
    bits = int(np.log2(len(model.idf)))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for texts in batches:
            parts = []
            for at in range(0, len(texts), LOT):
                parts.append(of.judge([run_counts(t, bits) for t in texts.iloc[at : at + LOT]]))
            yield pd.DataFrame({"lang_pred": [n for p in parts for n in p[0]], "score": np.concatenate([p[1] for p in parts]), "rejected": np.concatenate([p[2] for p in parts])})

    named = docs.select(*[F.col(f"`{c}`") for c in keep], judged(F.col(f"`{text}`")).alias("__judged"))
    return named.select(*[F.col(f"`{c}`") for c in keep], "__judged.lang_pred", "__judged.score", "__judged.rejected")


def held_out(doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held


def op11_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

"""Quality by compression: zstandard dictionaries of good and of bad text, and which of them makes a text smaller.

A text is cut into pieces of 256 bytes so that the dictionaries, not the text's own past, decide; every piece of the
whole text is compressed against both dictionaries. The normalised difference of the two compressed sizes, and nothing
else, is turned into a probability by a logistic curve fitted on labelled rows that taught no dictionary.

Learning uses a bounded, documented sample: at most ``most_rows`` labelled rows (smallest hash of doc_id, half of each
label), read whole. Six tenths of them teach the dictionaries with all their pieces: lots of about ``lot`` pieces each give a
dictionary, in tasks of their own, and a label's dictionary is trained on those of its lots (of one lot, it is that lot's).
Labels other than 0 and 1 teach nothing. Null and empty texts score as a difference of 0; texts of any length are read whole. Repeated rows score alike; copies teach
once. Of several labels of one doc_id the highest counts. Null labels or ids teach nothing. Without rows of both labels
every score is the known rate. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table
from .toxicity import SEED, teaching_rows, with_held_out

PIECE = 256
DICTIONARY_BYTES = 112_640
LEVEL = 3
MOST_ROWS = 8000
LOT_PIECES = 60_000
CUT = 0.3


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; with too few samples to train on, their raw content."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8, b" ")


class Sizer:
    """Compressed bytes of a text against the two dictionaries."""

    def __init__(self, bad: bytes, good: bytes):
        kind = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        of = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **kind)
        self.bad, self.good = of(bad), of(good)

    def difference(self, text: str | None) -> float:
        """The normalised difference of the compressed sizes, above 0 if the good dictionary wins."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        a = b = 0
        for piece in pieces(raw):
            a += len(self.bad.compress(piece))
            b += len(self.good.compress(piece))
        return (a - b) / (a + b)


def curve(difference: np.ndarray) -> np.ndarray:
    d = np.clip(difference * 10, -8, 8)
    return np.stack([np.ones_like(d), d, d * np.abs(d)], axis=1)


@dataclass
class QualityModel:
    bad: bytes
    good: bytes
    weights: np.ndarray

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve(difference) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return w


def measure(rows: DataFrame, bad: bytes, good: bytes, keep: list[str]) -> DataFrame:
    """The kept columns with ``difference`` of their whole text; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((bad, good))  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(*shared.value)
        for texts in batches:
            yield pd.Series([sizer.difference(t) for t in texts], dtype="float64")

    return rows.select(*keep, measured("text").alias("difference"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most_rows: int = MOST_ROWS, lot: int = LOT_PIECES) -> QualityModel:
    taught = with_held_out(labels, label, folds, held).filter(F.col("label").isin(0, 1))
    counts = {int(r["label"]): int(r["count"]) for r in taught.groupBy("label").count().collect()}  # a row for each label
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(10))
    chosen = teaching_rows(only(docs, doc_id="doc_id", text="text"), taught, most_rows, smaller=0)
    rate = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    plain = QualityModel(b" " * 8, b" " * 8, np.array([rate, 0, 0]))
    if len([n for n in counts.values() if n]) < 2:
        return plain

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(int(y), p) for y, t in zip(f["label"], f["text"]) if t for p in pieces(t.encode("utf-8", "surrogatepass"))]
            yield pd.DataFrame(rows, columns=["label", "piece"])

    every = chosen.filter(part < 6).select("label", "text").dropDuplicates(["text"]).mapInPandas(cut, "label int, piece binary")
    sizes = {int(r["label"]): int(r["count"]) for r in every.groupBy("label").count().collect()}  # a row for each label
    if not sizes.get(0) or not sizes.get(1):
        return plain
    lots = F.when(F.col("label") == 0, -(-sizes[0] // lot)).otherwise(-(-sizes[1] // lot))
    order = F.xxhash64("piece", F.lit(SEED))

    def of_lot(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["at", "piece"])  # about ``lot`` pieces
        return pd.DataFrame({"label": [int(group["label"].iloc[0])], "lot": [int(group["lot"].iloc[0])], "content": [dictionary([bytes(p) for p in own["piece"]])]})

    dealt = every.select("label", "piece", order.alias("at")).withColumn("lot", F.pmod(F.col("at"), lots))
    made = dealt.groupBy("label", "lot").applyInPandas(of_lot, "label int, lot bigint, content binary").collect()  # a dictionary of fixed size a lot
    of = {y: [bytes(r["content"]) for r in sorted(made, key=lambda r: r["lot"]) if r["label"] == y] for y in (0, 1)}
    bad, good = (of[y][0] if len(of[y]) == 1 else dictionary([p for d in of[y] for p in pieces(d)]) for y in (0, 1))
    rest = measure(chosen.filter(part >= 6), bad, good, ["label"]).toPandas()  # at most most_rows numbers
    y = rest["label"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(bad, good, np.array([rate, 4.0, 0]))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return QualityModel(bad, good, logistic(curve(rest["difference"].to_numpy()), y, weight))


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    sized = measure(docs, model.bad, model.good, keep)
    weights = model.weights.tolist()

    @F.pandas_udf("double")
    def probability(difference: pd.Series) -> pd.Series:
        return pd.Series(QualityModel(b"", b"", np.array(weights)).probability(difference.to_numpy()))

    return sized.select(*keep, probability("difference").alias("score"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

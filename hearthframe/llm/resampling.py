"""Importance resampling towards a target distribution over hashed word runs.

The document-by-bucket count matrix is written once, as compressed sparse rows in blocks of bounded size, of which a task
reads a bounded number at once. Its column sums give the raw distribution, those of the target texts' matrix the target distribution; the log ratios are the buckets'
gains, and the product of the matrix with the gains gives the documents' weights. Gumbel noise by id makes the highest
scores a draw without replacement; scores are cut at the draw's size by their histogram and ranked by ranges.

Null and empty texts have no features, weight 0 and are never drawn. Whole texts are read, of any length, a megabyte at a time.
Repeated rows are rows of their own; of equal score and id the first in the written table comes first. A null id counts as an
empty string under the hash and comes before all others. Empty tables give an empty result; without target texts all gains come
from the raw counts alone. Other columns of the input are not read. Nothing is sampled: counts cover all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, Scratch, only, table

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
MOST_ROWS, MOST_ENTRIES = 4096, 1 << 15
#: Blocks of the written matrix that a task reads at once.
BLOCKS_AT_ONCE = 64
PIECE = 1 << 20
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Whole words of a text whose separators are spaces, about ``size`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def text_buckets(text: str | None, known: Remembered, longest: int = 1) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words of a text, in lots put one after the other."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
    found, carried = [np.empty(0, np.int64)], []
    for piece in pieces(raw):
        words = piece.split()
        found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        for n in range(2, longest + 1):
            held = carried[len(carried) - min(len(carried), n - 1) :] + words
            found.append(np.fromiter((known[b" ".join(held[i : i + n])] for i in range(len(held) - n + 1)), np.int64))
        carried = (carried + words)[-(longest - 1) :] if longest > 1 else []
    return np.concatenate(found)


MATRIX = "doc array<bigint>, n array<bigint>, upto array<int>, bucket array<int>, times array<int>"


def count_matrix(docs: DataFrame, doc: str, text: str = "text", buckets: int = BUCKETS, longest: int = 1, most_rows: int = MOST_ROWS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Blocks of compressed sparse rows: row i of a block has the features ``bucket[upto[i-1]:upto[i]]``, ``times`` each, ``n`` in all. No shuffle."""
    rows = only(docs, doc=doc, text=text).withColumn("doc", F.col("doc").cast("bigint"))

    def block(held: list[tuple]) -> pa.RecordBatch:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        b, t = (np.concatenate([h[i] for h in held]).astype(np.int32) for i in (2, 3))
        return pa.RecordBatch.from_arrays(
            [one([h[0] for h in held], pa.int64()), one([h[1] for h in held], pa.int64()), one(np.cumsum([len(h[2]) for h in held]), pa.int32()), one(b, pa.int32()), one(t, pa.int32())],
            names=["doc", "n", "upto", "bucket", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda feature: zlib.crc32(feature) % buckets, 200_000)
        held, entries = [], 0
        for batch in batches:
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                of = text_buckets(texts[i].as_py(), known, longest)
                names, times = np.unique(of, return_counts=True)
                held.append((ids[i].as_py(), len(of), names, times))
                entries += len(names)
                if entries >= most_entries or len(held) >= most_rows:
                    yield block(held)
                    held, entries = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, MATRIX)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: a dense sum a task, added up by bucket; the driver gets ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            b, t = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            total += np.bincount(b, weights=t, minlength=buckets).astype(np.int64)  # exact below 2^53 a batch
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("bucket", "times").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's target share to its raw share, one feature added to each bucket, rounded down."""
    n, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def matrix_product(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc, n, weight) of every row of the matrix: the sum of its features' gains over their number, rounded down; 0 for none."""
    shared = matrix.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n, upto, bucket, times = (batch.column(c)[i].values for c in ("doc", "n", "upto", "bucket", "times"))
                sums = np.concatenate([[0], np.cumsum(g[bucket.to_numpy()] * times.to_numpy().astype(np.int64))])
                ends, count = upto.to_numpy(), n.to_numpy()
                total = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                yield pa.RecordBatch.from_arrays([doc, n, pa.array(total // np.maximum(count, 1), pa.int64())], names=["doc", "n", "weight"])

    return matrix.select("doc", "n", "upto", "bucket", "times").mapInArrow(run, "doc bigint, n bigint, weight bigint")


def gumbel(doc: str = "doc", seed: int = SEED):
    """Thousandths of a Gumbel variate by id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, scratch: Scratch, least: int, percent: int) -> DataFrame:
    """Adds ``rank``: 1, 2, ... of the drawn rows (highest scores, ties to the smaller id, then to the earlier row), null for all others.

    Of the n rows with at least ``least`` features a share of ``percent`` is drawn. Only rows at or above the cut score are
    sorted, in ranges written with their places; a range's first rank is the number of rows in the ranges before it.
    """
    able = F.col("n") >= least
    counts = sorted(((r["score"], r["c"]) for r in scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # distinct scores: a bounded range of whole numbers
    draw = percent * sum(c for _, c in counts) // 100
    cut, seen = None, 0
    for value, c in counts:
        if seen >= draw:
            break
        cut, seen = value, seen + c
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    order = [F.desc("score"), F.asc_nulls_first("doc"), F.asc("row")]
    top = scored.filter(able & (F.col("score") >= cut)).select("row", "doc", "score").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.write(top.select("row", F.monotonically_increasing_id().alias("at")), "placed")
    split = placed.select("row", F.shiftright("at", 33).alias("range"), (F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))
    sizes = sorted((r["range"], r["c"]) for r in split.groupBy("range").agg(F.count(F.lit(1)).alias("c")).collect())  # a row a range
    before, rows = 0, []
    for name, c in sizes:
        rows.append((name, before))
        before += c
    starts = scored.sparkSession.createDataFrame(rows, "range bigint, before bigint")
    ranks = split.join(F.broadcast(starts), "range").select("row", (F.col("before") + F.col("place")).alias("rank")).filter(F.col("rank") <= draw)
    return scored.join(ranks, "row", "left")


def resample(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rows with a rank are the draw."""
    scratch = Scratch(docs.sparkSession, "resampling")
    matrix = scratch.write(count_matrix(docs, doc, text, buckets, longest), "matrix", rows_a_group=BLOCKS_AT_ONCE)
    aim = count_matrix(target.select(F.lit(0).alias("d"), F.col(f"`{target_text}`").alias("t")), "d", "t", buckets, longest)
    product = matrix_product(matrix, bucket_gains(column_sums(matrix, buckets), column_sums(aim, buckets)))
    scored = scratch.write(product.withColumn("score", F.col("weight") + gumbel("doc", seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    scratch.drop("matrix")
    return ranked(scored, scratch, least, percent).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_features"), "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a byte string, bit by bit over its bytes (the reflected polynomial 0xEDB88320).
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH dw AS (SELECT doc_id, unnest(words) AS w FROM (SELECT doc_id, {_WORDS} AS words FROM documents)),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
names AS (SELECT w, {_CRC} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN names USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN names USING (w) GROUP BY 1),
gains AS (
  SELECT b.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range),
weights AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)::DOUBLE) AS BIGINT) AS weight FROM dw JOIN names USING (w) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

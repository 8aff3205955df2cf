"""Nearest neighbours by shifted space-filling curves (after Liao, Lopez and Leutenegger, 2001).

1. Equal vectors are one node, which keeps the ``k + 1`` smallest of its vec_ids: no answer can hold more of them.
2. Nodes are projected to few dimensions, shifted, and ordered along a Hilbert curve, several times over with other
   projections and shifts. Each ordering is range-partitioned and sorted by Spark and cut into blocks by rank.
3. A query meets the blocks around its place on each curve. Queries of neighbouring blocks go together, as a job of at
   most about ``QUERIES_AT_ONCE``, and the rows of their windows stream past them; a job holds its queries, their best so
   far and one chunk of rows. The windows of all curves merge, reranked by the exact inner product. Nothing outside the
   windows is looked at.
4. Which curves are used, how many, and how wide their windows are is fitted on a bounded sample of the queries (``SAMPLE``): their
   true neighbours among all nodes are found by a scan, and the cheapest windows that hold the target share of them
   are taken. So windows are a few blocks wide where vectors lie in clusters, and grow with the table where they have
   no structure to follow; at a target of 1 they span it, and the search is exact.

Products are in double precision on the original vectors, summed in order of dimension, so equal vectors score alike;
ties fall to the smaller vec_id. Rows with null or zero vectors, null or non-finite components, a length other than the
most frequent one, or without vec_id take no part. Repeated rows are candidates and queries of their own; a query leaves
out just one row of its own id and vector. Other columns of the input are not read. Queries are a stated set: vec_id
divisible by 20. Without any other vector a query has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table

CURVES = 6
FEWEST_CURVES = 2
#: Dimensions of a projection and bits of each: few dimensions order vectors without structure best, more of them keep
#: clusters apart. Each family has CURVES curves; an answer uses the first few of one family.
FAMILIES = ((2, 16), (8, 7))
BLOCK = 1024
QUERIES_AT_ONCE = 1024
NEAREST = 20
#: Target share of true neighbours in the windows, and the number of queries it is fitted on.
RECALL = 0.95
SAMPLE = 256
SEED = 3
_U = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers (Skilling's transform, 2004), all rows at once."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    top = _U(1) << _U(bits - 1)
    q = top
    while q > 1:
        p = q - _U(1)
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(inside, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(inside, x[i], x[i] ^ swap)
        q >>= _U(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - _U(1)), t)
        q >>= _U(1)
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << _U(1)) | ((x[i] >> _U(b)) & _U(1))
    return key.astype(np.int64)


def curve_keys(x: np.ndarray, rms: float, curve: int) -> np.ndarray:
    """Keys of one curve: its own projection and shift, cells over about seven standard deviations."""
    dimensions, bits = FAMILIES[curve // CURVES]
    rng = np.random.default_rng([SEED, curve, x.shape[1]])
    m = min(dimensions, x.shape[1])
    axes = np.linalg.qr(rng.normal(size=(x.shape[1], m)))[0]
    shift = rng.uniform(0, 1, m)
    spread = rms / np.sqrt(x.shape[1])
    at = (x @ axes) / (spread or 1.0) / 7.0 + 0.5
    cells = np.clip((at + shift) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part, all of the most frequent length."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("vector"))
    most = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    return kept.filter(F.size("vector") == (most[0]["d"] if most else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.empty((0, 1))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of dimension."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[:, d]
    return total


NODES = "node long, least long, asks boolean, vec binary"


def nodes_of(rows: DataFrame, every: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, least, asks, vec), their heads (node, heads) and the query rows (query_id, node).

    A vector is known by two 64-bit hashes of it. Copies are combined before the shuffle.
    """
    vectors = valid_vectors(rows).withColumns({"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")})
    vectors = scratch.write(vectors, "vectors")
    asks = F.pmod("vec_id", F.lit(every)) == 0
    one = vectors.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.bool_or(asks).alias("asks"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h1", "h2", "least", "asks")], pa.array([r.tobytes() for r in x], pa.binary())], names=["h1", "h2", "least", "asks", "vec"])

    nodes = one.mapInArrow(packed, "h1 long, h2 long, least long, asks boolean, vec binary").withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.write(nodes, "nodes")  # from here on the numbers are fixed
    numbered = vectors.select("vec_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node")
    first = numbered.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    heads = first.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("heads"))  # at most k + 1 of each
    return nodes.select("node", "least", "asks", "vec"), heads, numbered.filter(asks).select(F.col("vec_id").alias("query_id"), "node")


def ranked(nodes: DataFrame, scratch: Scratch, curves: int) -> DataFrame:
    """(curve, node, rank): places along each curve.

    Keys are range-partitioned and written with their place in the partition; prefix sums over the counts of (curve,
    partition) turn that into ranks.
    """
    rms = scratch_rms(nodes)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = matrix(batch.column("vec"))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(curve_keys(x, rms, c)), batch.column("node")], names=["curve", "key", "node"])

    keyed = nodes.select("node", "vec").mapInArrow(made, "curve int, key long, node long")
    placed = keyed.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node").withColumn("place", F.monotonically_increasing_id())
    placed = scratch.write(placed.select("curve", "node", F.shiftright("place", 33).cast("int").alias("part"), "place"), "placed")
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("curve", "part", "first", before.alias("before"))
    return scratch.write(placed.join(starts, ["curve", "part"]).select("curve", "node", (F.col("before") + F.col("place") - F.col("first")).alias("rank")), "ranks")


def scratch_rms(nodes: DataFrame) -> float:
    """Root mean square length of the vectors: the scale of the cells."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum())]), pa.array([batch.num_rows], pa.int64())], names=["s", "n"])

    return nodes.select("vec").mapInArrow(squares, "s double, n long").agg(F.sqrt(F.sum("s") / F.sum("n"))).collect()[0][0] or 1.0  # one number


def true_neighbours(nodes: DataFrame, sample: list, k: int) -> DataFrame:
    """(asker, node) of the k best other nodes of each sampled node, by a scan of all; each task keeps k a query."""
    ids = np.array([r["node"] for r in sample], np.int64)
    q = np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float64).reshape(len(sample), -1)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), 0), -np.inf)
        who = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column("node").to_numpy()
            product = q @ matrix(batch.column("vec")).T
            product[ids[:, None] == mine[None, :]] = -np.inf
            best, who = np.concatenate([best, product], axis=1), np.concatenate([who, np.broadcast_to(mine, product.shape)], axis=1)
            if best.shape[1] > k:
                at = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(best, at, axis=1), np.take_along_axis(who, at, axis=1)
        fine = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[fine]), pa.array(who[fine]), pa.array(best[fine])], names=["asker", "node", "score"])

    found = nodes.select("node", "vec").mapInArrow(scanned, "asker long, node long, score double")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "node")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("asker", "node")


def fit_windows(nodes: DataFrame, ranks: DataFrame, k: int, block: int, recall: float, sample: int = SAMPLE) -> tuple[int, int, int]:
    """(first, curves, reach): the cheapest windows of ``reach`` blocks to either side on so many curves that hold the target share
    of the sampled queries' true neighbours."""
    total = nodes.count()
    blocks = max(1, -(-total // block))
    if blocks <= 3 or recall >= 1:
        return 0, 1, blocks
    asked = nodes.filter("asks").select("node", "vec").orderBy(F.xxhash64("vec")).limit(sample).collect()  # at most ``sample`` vectors
    if not asked:
        return 0, FEWEST_CURVES, 1
    pairs = true_neighbours(nodes, asked, k)
    here = ranks.select(F.col("node").alias("asker"), "curve", F.col("rank").alias("from"))
    apart = pairs.join(ranks, "node").join(here, ["asker", "curve"]).groupBy("asker", "node").agg(F.map_from_entries(F.collect_list(F.struct("curve", F.abs(F.col("rank") - F.col("from"))))).alias("d"))
    got = apart.select("d").collect()  # at most sample * k rows of so many numbers as curves
    far = np.array([[r["d"][c] for c in range(CURVES * len(FAMILIES))] for r in got], np.float64)
    options = []
    for first in range(0, CURVES * len(FAMILIES), CURVES):
        for curves in range(FEWEST_CURVES, CURVES + 1):
            least = np.sort(far[:, first : first + curves].min(axis=1))
            need = least[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)]
            reach = min(blocks, max(1, int(np.ceil(need / block))))
            options.append((curves * min(blocks, 2 * reach + 1), curves, first, reach))
    cost, curves, first, reach = min(options)
    return (first, curves, reach) if cost < FEWEST_CURVES * blocks else (0, 1, blocks)  # windows that span the table: one curve is enough


PAIRS = "curve int, asker long, node long, least long, score double"


class Meeting:
    """Queries of one job and the k best nodes each has seen."""

    def __init__(self, k: int):
        self.k = k
        self.asked: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.q: np.ndarray | None = None
        self.best: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))

    def ask(self, nodes: np.ndarray, vectors: np.ndarray) -> None:
        self.asked.append(nodes)
        self.vectors.append(vectors)

    def see(self, nodes: np.ndarray, least: np.ndarray, x: np.ndarray) -> None:
        if not self.asked:
            return
        if self.q is None:
            self.q = np.concatenate(self.vectors)
            self.floor = np.full(len(self.q), -np.inf)
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            product = self.q @ part.T
            own = np.partition(product, max(0, len(part) - self.k), axis=1)[:, max(0, len(part) - self.k)]
            floor = np.maximum(own, self.floor) if len(part) >= self.k else self.floor
            with np.errstate(invalid="ignore"):
                floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)  # the fast product is near the exact one; ties stay in
            i, j = np.nonzero(product >= floor[:, None])
            new = (i, inner(part[j], self.q[i]), least[a + j], nodes[a + j])
            i, score, low, node = (np.concatenate([u, v]) for u, v in zip(self.best, new))
            order = np.lexsort((node, low, -score, i))
            i = i[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = order[place < self.k]
            self.best = (i[place < self.k], score[kept], low[kept], node[kept])
            last = place == self.k - 1
            self.floor[i[last]] = score[order][last]

    def result(self, curve: int) -> pa.RecordBatch:
        i, score, low, node = self.best
        asked = np.concatenate([np.empty(0, np.int64), *self.asked])
        made = [np.full(len(i), curve, np.int32), asked[i.astype(np.int64)], node, low, score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["curve", "asker", "node", "least", "score"])


def meet(rows: DataFrame, k: int) -> DataFrame:
    """The k best nodes each query of a job meets there; rows: (curve, job, chunk, query, node, least, vec)."""
    keys = ["curve", "job", "chunk"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "query"]]
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0).nonzero()[0] + 1
            nodes, least, x = batch.column("node").to_numpy(), batch.column("least").to_numpy(), matrix(batch.column("vec"))
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                key = tuple(c[a] for c in columns[:3])
                if key != last:
                    if now is not None:
                        yield now.result(last[0])
                    last, now = key, Meeting(k)
                if columns[3][a]:
                    now.ask(nodes[a:b], x[a:b])
                else:
                    now.see(nodes[a:b], least[a:b], x[a:b])
        if now is not None:
            yield now.result(last[0])

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("query"), "node").mapInArrow(met, PAIRS)


def in_windows(nodes: DataFrame, ranks: DataFrame, first_curve: int, curves: int, reach: int, block: int, k: int, scratch: Scratch) -> DataFrame:
    """(asker, node, least, score): the k best nodes of each asking node in its windows, itself among them."""
    placed = ranks.filter(F.col("curve").between(first_curve, first_curve + curves - 1)).withColumn("block", F.floor(F.col("rank") / block).cast("int")).drop("rank").join(nodes, "node")
    placed = scratch.write(placed, "blocks")
    size = placed.agg(F.count_if("asks").alias("asks"), F.max("block").alias("last")).collect()[0]  # two numbers
    per_block = -(-(size["asks"] or 0) // max(1, curves * ((size["last"] or 0) + 1)))
    together = max(1, QUERIES_AT_ONCE // max(1, per_block))  # blocks whose queries go together
    asking = placed.filter("asks").withColumn("job", F.floor(F.col("block") / together).cast("int"))
    jobs = asking.groupBy("curve", "job").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("chunks"))
    first, last = F.floor((F.col("block") - reach) / together).cast("int"), F.floor((F.col("block") + reach) / together).cast("int")
    held = placed.withColumn("job", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).join(jobs, ["curve", "job"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asking = asking.join(jobs, ["curve", "job"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    of = lambda df, query: df.select("curve", "job", "chunk", F.lit(query).alias("query"), "node", "least", "vec")
    best = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "least", "node"))).filter(F.col("n") <= k).drop("n")
    return best(meet(of(held, False).unionByName(of(asking, True)), k).select("asker", "node", "least", "score").distinct(), ["asker"])


def search(rows: DataFrame, every: int = 20, k: int = NEAREST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding); ``recall`` is the target share of true neighbours, 1 is exact."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    nodes, heads, queries = nodes_of(rows, every, k, scratch)
    ranks = ranked(nodes, scratch, CURVES * len(FAMILIES))
    first, curves, reach = fit_windows(nodes, ranks, k, block, recall)
    found = in_windows(nodes, ranks, first, curves, reach, block, k + 1, scratch)
    # Nodes back to rows: at most k + 1 nodes of at most k + 1 heads each, of which the first k + 1 can be in an answer.
    spread = found.join(heads, "node").select("asker", "score", F.explode("heads").alias("vec_id"), (F.col("node") == F.col("asker")).alias("own"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    lists = spread.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("list"))
    answers = queries.join(lists, queries["node"] == lists["asker"]).select("query_id", "list")
    itself = F.array_min(F.transform(F.filter("list", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), lambda x: x["n"]))
    others = F.slice(F.filter("list", lambda x: x["n"] != F.coalesce(itself, F.lit(-1))), 1, k)
    ordered = answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    out = scratch.write(ordered, "answers")
    scratch.drop_all_but("answers")
    return out


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(only(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding"))


#: At the scale this is compared on, the windows span the table, so the answer is the exact one.
ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT len(e) AS n FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
g AS (SELECT f.* FROM f JOIN d ON len(e) = d.n),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM g q JOIN g c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

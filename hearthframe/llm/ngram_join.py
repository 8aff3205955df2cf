"""N-gram Jaccard join by chosen paths (Christiani, Pagh and Sivertsen's recursive join).

Texts are sets of five-word shingles; two texts are linked at a Jaccard similarity of 0.8 or more.

1. Equal texts are one node. A node carries the size of its set and 64 sampled tokens: the least shingles under 64
   hash functions, so two sets share a token with the probability of their similarity.
2. Sets are split on sampled shared tokens: each run picks BRANCH tokens at the root, and a set goes to the bucket of
   each. The LEADERS sets of least node (a hash of the text) lead a bucket, whatever its size, and every set is held against them by its
   tokens: a set near a leader is tied to it, and one that is far from all goes down the recursion, split on further
   tokens, until nothing is left. So a bucket of no more sets than leaders is compared whole. Buckets are dealt to chunks
   of about CHUNK sets, each with the bucket's leaders, which are elected across chunks by a ranking that is cut before
   the shuffle; no task gathers a bucket. Runs repeat until the target recall, which ``runs_for`` turns into their number.
3. Ties join to groups of possible links. Each group is checked exactly, by whole shingle sets, in blocks of BLOCK
   texts against BLOCK texts; a pair is looked at once. Links are counted, not written out: every text returns its
   number of links and one tie into its class.

Null and empty texts have no shingles and no links; being equal, they form one class. Texts of one to four words are
one shingle; texts of any length are read whole. Repeated rows and copies share a class. A class is named by its least
doc_id (null ids are last); a class without ids has a null name. Of rows that tie for staying (equal id and text), one
stays. Other columns of the input are carried by ``stage`` and not read by ``join``. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, Scratch, only, stream_groups, table, text_or_empty
from .components import connected_components
from .contamination import WORDS_SQL, words

SHINGLE = 5
SIMILARITY = 0.8
TOKENS = 64
BRANCH = 4
#: Below the root fewer tokens split a bucket: sets that share under half their tokens then thin out level by level.
BRANCH_BELOW = 2
RECALL = 0.9999
LEADERS = 64
CHUNK = 2048
#: Every level takes the leaders out of each bucket, so the recursion ends; this many levels without an end is an error.
MOST_LEVELS = 400
#: Levels at which a pair is taken to be split, in all its buckets, when the number of runs is worked out.
LEVELS_COUNTED = 4
BLOCK = 256
#: Equal tokens of 64 from which a set is absorbed by a leader, or tied to it. Distances add up: what is linked to an
#: absorbed set (0.44 from the leader at most) is within 0.64 of that leader, so it is tied to the same one.
ABSORBED, TIED = 36, 22
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a public mixing function."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_RANDOM = np.random.default_rng(20)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_SHINGLE_MULTIPLIERS = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; remembers a bounded number of words."""

    def __init__(self, remember: int = 100_000):
        self.known = Remembered(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), remember)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = words(text)
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = len(h) - SHINGLE + 1
        if n < 1:
            return mix64(np.array([(h * _SHINGLE_MULTIPLIERS[: len(h)]).sum() + _U(len(h))], np.uint64))
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total += h[k : k + n] * _SHINGLE_MULTIPLIERS[k]
        return np.unique(mix64(total))


def sampled_tokens(shingles: np.ndarray) -> np.ndarray:
    """The least shingle under each of 64 hash functions, as 32 bits."""
    out = np.empty(TOKENS, np.uint32)
    for a in range(0, TOKENS, 8):
        out[a : a + 8] = ((shingles[None, :] * _MULTIPLIERS[a : a + 8, None]) >> _U(32)).min(axis=1).astype(np.uint32)
    return out


def runs_for(recall: float, similarity: float = SIMILARITY, levels: int = LEVELS_COUNTED) -> int:
    """Runs until a pair at the threshold is met with the target probability, were it split at so many levels."""
    missed = 1 - (1 - (1 - similarity) ** BRANCH) * (1 - (1 - similarity) ** BRANCH_BELOW) ** (levels - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def chosen_tokens(paths: np.ndarray, branch: int) -> np.ndarray:
    """By path, the indices of the tokens that split its bucket: those of least hash with the path."""
    mixed = mix64(paths[:, None] ^ mix64(np.arange(1, TOKENS + 1, dtype=np.uint64))[None, :])
    return np.argpartition(mixed, branch, axis=1)[:, :branch]


def child_paths(paths: np.ndarray, tokens: np.ndarray, branch: int = BRANCH_BELOW) -> np.ndarray:
    """Rows of child paths for rows of (path, tokens)."""
    at = chosen_tokens(paths, branch)
    value = np.take_along_axis(tokens.astype(np.uint64), at, axis=1)
    return mix64(mix64(paths[:, None] + at.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) ^ (value + _U(1)))


def describe(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, node, size, tokens, paths) of (doc_id, text): tokens as 16 bits each, paths of the first level."""
    roots = mix64(np.arange(101, 101 + runs, dtype=np.uint64))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            nodes, sizes, tokens, paths = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                nodes.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                s = shingler(text)
                sizes.append(len(s))
                if not len(s):
                    tokens.append(b"")
                    paths.append([])
                    continue
                t = sampled_tokens(s)
                tokens.append((t & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                paths.append(child_paths(roots, np.broadcast_to(t, (runs, TOKENS)), BRANCH).ravel().view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "node": pa.array(nodes, pa.binary()), "size": pa.array(sizes, pa.int32()), "tokens": pa.array(tokens, pa.binary()), "paths": pa.array(paths, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(described, "doc_id long, node binary, size int, tokens binary, paths array<long>")


def _roots(near: np.ndarray) -> np.ndarray:
    """Least index reachable from each, of a symmetric boolean matrix."""
    label = np.arange(len(near))
    big = len(near)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], big).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tied_parts(near: np.ndarray, among: np.ndarray) -> np.ndarray:
    """By leader, the least leader of its part: leaders are one part if they are near each other or to one set."""
    label = np.arange(near.shape[1])
    big = len(label)
    while True:
        of_set = np.where(near, label[None, :], big).min(axis=1)
        new = np.minimum(label, np.where(near, of_set[:, None], big).min(axis=0, initial=big))
        new = np.minimum(new, np.where(among, label[None, :], big).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


BUCKET_SCHEMA = "path long, node binary, tokens binary, leader binary"


def bucket_pass(rows: DataFrame, leaders: int) -> DataFrame:
    """Ties (node, leader) within each bucket, and the rows to split further.

    rows (path, chunk, leads, node, tokens) come sorted so, leading rows first. A chunk of a bucket dealt to several has the bucket's
    leaders as extra rows that lead; the leaders of a bucket in one chunk are its first rows. A row with a leader is a
    tie; a row without one goes down under its new path.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[], [], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["path", "node", "tokens", "leader"])
            out.clear()
            return batch

        for group in stream_groups(batches, ["path", "chunk"]):
            nodes = group.column("node").to_pylist()
            every = np.frombuffer(b"".join(group.column("tokens").to_pylist()), np.uint16).reshape(len(nodes), TOKENS)
            leads = group.column("leads").to_numpy(zero_copy_only=False).astype(bool)
            first = int(leads.sum())  # extra rows sort before the others
            lead = every[:first] if first else every[:leaders]
            t, own = every[first:], nodes[first:]
            equal = np.concatenate([np.empty((0, len(lead)), np.int64), *[(t[a : a + 256, None, :] == lead[None]).sum(axis=2) for a in range(0, len(t), 256)]])
            near = equal >= TIED
            part = tied_parts(near, (lead[:, None, :] == lead[None]).sum(axis=2) >= TIED)
            tied = np.flatnonzero(near.any(axis=1))
            root = part[near[tied].argmax(axis=1)]
            # One tie a row, to the least leader of its part: the same one in most buckets of a group.
            out += [(None, own[j], None, nodes[r]) for j, r in zip(tied.tolist(), root.tolist()) if own[j] != nodes[r]]
            out += [(None, nodes[k], None, nodes[r]) for k, r in enumerate(part.tolist()) if k != r and nodes[k] != nodes[r]]
            rest = np.flatnonzero(~(equal >= ABSORBED).any(axis=1))
            if len(rest):
                path = np.full(len(rest), group.column("path")[0].as_py(), np.int64).view(np.uint64)
                for j, row in zip(rest.tolist(), child_paths(path, t[rest]).view(np.int64).tolist()):
                    token = t[j].tobytes()
                    out += [(p, own[j], token, None) for p in row]
                    if len(out) >= 20_000:
                        yield emit()
            if len(out) >= 20_000:
                yield emit()
        yield emit()

    return rows.mapInArrow(passed, BUCKET_SCHEMA)


def possible_ties(nodes: DataFrame, scratch: Scratch, leaders: int = LEADERS, chunk: int = CHUNK, levels: int = MOST_LEVELS) -> DataFrame:
    """(u, v) ties whose components hold every linked pair, of nodes (node, tokens, paths)."""
    ties: DataFrame | None = None
    rows = nodes.select(F.explode("paths").alias("path"), "node")
    columns = ["path", "chunk", "leads", "node", "tokens"]
    for level in range(1, levels + 1):
        several = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        several = scratch.write(several, f"several{level}")
        shared = rows.join(several, "path")
        if level == 1:
            shared = shared.join(nodes.select("node", "tokens"), "node")
        shared = shared.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
        dealt = shared.withColumns({"chunk": F.pmod(F.xxhash64("node", "path"), F.col("chunks")).cast("int"), "leads": F.lit(0)}).select(*columns)
        if not several.filter(F.col("n") > chunk).isEmpty():
            by_node = Window.partitionBy("path").orderBy("node")
            elected = shared.filter("chunks > 1").withColumn("place", F.row_number().over(by_node)).filter(F.col("place") <= leaders)
            copies = elected.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "leads": F.lit(1)}).select(*columns)
            dealt = dealt.unionByName(copies)
        made = bucket_pass(dealt.repartition("path", "chunk").sortWithinPartitions("path", "chunk", F.desc("leads"), "node"), leaders)
        made = scratch.write(made, f"level{level}")
        tied = made.filter("leader is not null").select(F.col("node").alias("u"), F.col("leader").alias("v"))
        ties = tied if ties is None else ties.unionByName(tied)
        rows = made.filter("leader is null").select("path", "node", "tokens")
        if rows.isEmpty():
            return ties
    raise RuntimeError(f"sets are still split after {levels} levels")


VERIFIED_SCHEMA = "node binary, links long, tie binary"


def verify(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per text of a block pair with a link: its links there, and a tie to the least text it is joined with.

    texts: (job, bi, bj, block, node, text) sorted by job within partitions; a job is a pair of blocks of a group.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for group in stream_groups(batches, ["job", "bi", "bj"]):
            nodes = group.column("node").to_pylist()
            block = group.column("block").to_numpy()
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            sets = [shingler(t) for t in group.column("text").to_pylist()]
            near = linked(sets, similarity)
            if bi != bj:
                near &= block[:, None] != block[None, :]
            links = near.sum(axis=1)
            label = _roots(near)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[j] for j in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([nodes[label[j]] for j in some], pa.binary())], names=["node", "links", "tie"])

    return texts.mapInArrow(checked, VERIFIED_SCHEMA)


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Booleans by pair: Jaccard similarity of at least the threshold, exactly; the diagonal is False."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only shingles of several sets can be shared
    width = int((count > 1).sum())
    row = np.repeat(np.arange(n), sizes)
    use = count[place] > 1
    row, column = row[use], number[place[use]]
    both = np.zeros((n, n), np.float32)
    step = max(1, 4_000_000 // max(n, 1))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((n, min(step, width - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    shared = np.rint(both).astype(np.int64)
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    near &= shared > 0
    np.fill_diagonal(near, False)
    return near


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, leaders: int = LEADERS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per row of (doc_id, text): (doc_id, node, class_id, n_links, n_copies, winner).

    n_links counts the different texts at the threshold or above; n_copies the rows of equal text; winner marks the
    text and id by which a class is kept when one document of it stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    described = scratch.write(describe(rows, runs_for(recall)), "described")
    nodes = described.groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("paths").alias("paths"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    nodes = scratch.write(nodes, "nodes")
    groups = connected_components(possible_ties(nodes.filter("size > 0"), scratch, leaders, chunk), scratch, "ties")
    groups = scratch.write(groups.select("node", F.col("label").alias("job")), "groups")
    # Number the texts of a group by hash into blocks; a block pair is a job of its own.
    sized = groups.groupBy("job").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    members = groups.join(sized, "job").join(nodes.select("node", "least"), "node").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keyed = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hex"), "text").select("doc_id", F.unhex("hex").alias("node"), "text")
    # One row per text: by its least id, so that copies meet nowhere.
    found = members.select("job", "node", F.col("least").alias("__least"), "blocks", "block").join(keyed.withColumnRenamed("node", "__node"), (F.col("node") == F.col("__node")) & F.col("__least").eqNullSafe(F.col("doc_id")))
    one = found.groupBy("node", "__least").agg(*[F.first(c).alias(c) for c in ("job", "blocks", "block", "text")])
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = one.select("job", "node", "block", "text", F.explode(other).alias("with")).select("job", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "node", "text")
    sorted_jobs = spread.repartition("job", "bi", "bj").sortWithinPartitions("job", "bi", "bj", "node")
    verified = scratch.write(verify(sorted_jobs, similarity), "verified")
    classes = connected_components(verified.select(F.col("node").alias("u"), F.col("tie").alias("v")), scratch, "classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    full = nodes.select("node", "least", "n_copies").join(classes, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    full = scratch.write(full.select("node", "least", "n_copies", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "full")
    scratch.drop_all_but("described", "full")
    named = full.groupBy("label").agg(F.min("least").alias("class_id"), F.min_by("node", F.struct(F.col("least").isNull(), F.coalesce("least", F.lit(0)), "node")).alias("winner_node"))
    named = full.join(named, "label").select(F.col("node").alias("__node"), "class_id", "n_links", "n_copies", F.col("least").alias("__least"), (F.col("winner_node") == F.col("node")).alias("__won"))
    return described.select("doc_id", "node").join(named, F.col("node") == F.col("__node")).select("doc_id", "node", "class_id", "n_links", "n_copies", (F.col("__won") & F.col("doc_id").eqNullSafe(F.col("__least"))).alias("winner"))


def op8_chosen_path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id; of repeated rows, one."""
    given = docs.columns
    winners = join(docs.select("doc_id", "text")).filter("winner").select(F.col("doc_id").alias("__id"), F.col("node").alias("__of")).distinct()
    keyed = docs.withColumn("__node", F.unhex(F.md5(text_or_empty("text").cast("binary"))))
    kept = keyed.join(winners, (F.col("__node") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    others = [c for c in given if c != "doc_id"]
    return kept.groupBy("__node", "doc_id").agg(*[F.first(f"`{c}`").alias(c) for c in others]).select(*given)


ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, x AS text FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)),
w AS (SELECT id, {WORDS_SQL} AS w FROM t),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) u(i) WHERE len(w) > 0),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN z x ON x.id = u JOIN z y ON y.id = v WHERE c >= {SIMILARITY} * (x.n + y.n - c) - 1e-9),
r AS (SELECT id, id AS c FROM t UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id),
q AS (SELECT d.doc_id, t.id, k.c FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN k USING (id)),
n AS (SELECT u AS id, count(*) AS n_links FROM e GROUP BY u)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(count(*) OVER (PARTITION BY id) AS BIGINT) AS n_copies FROM q LEFT JOIN n USING (id)
"""

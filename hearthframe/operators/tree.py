"""Searches among points and boxes by a packed tree, held in tables.

Rows are put in order of a space-filling curve and cut into leaves of equal numbers; every sixteen neighbouring nodes make
the node above them, with the box that holds them. Dense places thus get many small leaves and empty space none, and no leaf
has more than a set number of rows, however the points lie and however many share one place.

A search goes down the tree once for each leaf of the asking points, not for each point: from level to level it keeps the
nodes that may still hold an answer for any point of the leaf, by least and greatest distances between boxes. A leaf that keeps
many nodes (its points lie far apart, and some place near them is dense) is split into sixteen, and these in the end into points,
which go on one by one. Only the leaves that are left are met row by row, so the rows a group meets are bounded by nodes and not
by the density of the data.

Large tables ask in blocks of a thousand points or more. What a block meets is sent once for the block, and narrowed in its task
for fewer and fewer neighbouring points: distances from a point differ from those from their middle by no more than the way there.
A block is wide beside the distances it asks for, so the nodes that its own box can't rule out are many times those that its
points need; they are held against the boxes of few of its points at a time (``_tightened``) before any row is sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _settled

#: Rows a leaf of the asking points, and a leaf of what is searched, which is met row by row.
CAPACITY, SMALL, FAN_BITS = 32, 8, 4
#: An asking leaf with more nodes than this on a level is split; so many split leaves at most are broadcast.
MOST_NODES, FEW_SPLIT = 128, 20_000
#: Rows a block of asking points, at least, and blocks of a large table, about; rows a leaf that blocks meet; nodes a block may
#: keep, as a multiple of MOST_NODES; points that meet the rows left for them together.
BLOCK, BLOCKS, HELD, WIDER, FEW = 1024, 4096, 32, 8, 32
_PART = 33  # a node's number is the range it lies in, shifted by so many bits, and its place in that range
_BOX = ("x0", "x1", "y0", "y1", "v0", "v1")


def known(*columns: Column) -> Column:
    """All of the numbers are there and finite."""
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(test, F.lit(False))


def _tasks(df: DataFrame) -> int:
    """Tasks to deal small rows of costly work to: a named number is not joined to fewer by size."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _curve(cells: list[Column], bits: int) -> Column:
    """Place on the curve: the bits of the cell numbers, by turns."""
    key = F.lit(0).cast("bigint")
    for i in range(bits):
        for d, c in enumerate(cells):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), i * len(cells) + d))
    return key


@dataclass
class Tree:
    """items: the rows with their ``__leaf`` and number ``__at``; boxes: (at, leaf and the box) of each; leaves: (node, n and the
    box); the number of rows and of leaves, and of levels above the leaves by place and by range."""

    items: DataFrame
    boxes: DataFrame
    leaves: DataFrame
    n: int
    n_leaves: int
    by_place: int
    by_range: int
    capacity: int
    rows: DataFrame  # as written, with the boxes

    def cut(self, capacity: int) -> Tree:
        """The same rows, as they lie, in leaves of another size."""
        return _cut(self.rows, capacity)

    @property
    def height(self) -> int:
        return self.by_place + self.by_range

    def above(self, node: Column, level: int) -> Column:
        """The node of a level (0: leaves) that holds a leaf."""
        part, place = F.shiftright(node, _PART), node.bitwiseAND(F.lit((1 << _PART) - 1))
        return F.shiftleft(F.shiftright(part, FAN_BITS * max(0, level - self.by_place)), _PART).bitwiseOR(F.shiftright(place, FAN_BITS * min(level, self.by_place)))

    def level(self, k: int) -> DataFrame:
        """(node, parent, n, box) of a level below the root."""
        ends = [(F.min if c.endswith("0") else F.max)(c).alias(f"n{c}") for c in _BOX]
        of = self.leaves.groupBy(self.above(F.col("node"), k).alias("node"), self.above(F.col("node"), k + 1).alias("parent"))
        return of.agg(F.sum("n").alias("n"), *ends)


def block_of(n: int, held: int, tied: int = 16) -> int:
    """Rows a block of n asking points: a single one where what is searched is so many times as large that a block's rows would be most of it, met again and again."""
    return 1 if held > tied * n else max(BLOCK, 1 << (max(n, 1) // BLOCKS).bit_length())


def build(rows: DataFrame, box: tuple[Column, Column, Column, Column], value: Column | None = None, capacity: int | Callable[[int], int] = CAPACITY) -> Tree:
    """A tree of rows by their boxes (x0, y0, x1, y1), whose nodes also know the least and greatest value, if one is given; rows
    with an unknown number in them are left out. capacity, a power of two, may follow from the number of rows.

    The rows are sorted once, by range, and written to the shared folder.
    """
    x0, y0, x1, y1 = (c.cast("double") for c in box)
    v = F.lit(0.0) if value is None else value.cast("double")
    own = dict(zip(_BOX, (x0, x1, y0, y1, v, v)))
    boxed = rows.withColumns({f"__{k}": c for k, c in own.items()}).filter(known(*[F.col(f"__{k}") for k in _BOX]))
    middle = {"x": (F.col("__x0") + F.col("__x1")) / 2, "y": (F.col("__y0") + F.col("__y1")) / 2}
    e = boxed.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{k}") for k, c in middle.items() for n, f in (("lo", F.min), ("hi", F.max))]).collect()[0]
    bits = 60 // len(middle)
    capacity = capacity(int(e["n"])) if callable(capacity) else capacity

    def cell(k: str, c: Column) -> Column:
        lo, hi = e[f"lo{k}"], e[f"hi{k}"]
        return (F.lit(0) if lo is None or not hi > lo else F.floor((c / 2 - lo / 2) / (hi / 2 - lo / 2) * ((1 << bits) - 1))).cast("bigint")

    placed = boxed.withColumns({f"__cell_{k}": cell(k, c) for k, c in middle.items()}).withColumn("__tie", F.xxhash64(*[f"`{c}`" for c in rows.columns]))
    placed = placed.withColumn("__key", _curve([F.col(f"__cell_{k}") for k in middle], bits)).drop(*[f"__cell_{k}" for k in middle])
    in_order = placed.repartitionByRange(_tasks(rows), "__key", "__tie").sortWithinPartitions("__key", "__tie").withColumn("__at", F.monotonically_increasing_id())
    # A range's number and a row's place in it are read off the written rows, so they don't change when a task is repeated.
    return _cut(_settled(in_order.drop("__key", "__tie")), capacity)


def _cut(rows: DataFrame, capacity: int) -> Tree:
    """The tree of rows in order, which know their place ``__at`` and their box."""
    items = rows.withColumn("__leaf", _group(F.col("__at"), capacity))
    leaves = _settled(items.groupBy(F.col("__leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *[(F.min if c.endswith("0") else F.max)(f"__{c}").alias(c) for c in _BOX]))
    top = leaves.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("leaves"), F.max(F.col("node").bitwiseAND(F.lit((1 << _PART) - 1))).alias("place"), F.max(F.shiftright("node", _PART)).alias("part")).collect()[0]
    levels = lambda most: math.ceil((most or 0).bit_length() / FAN_BITS)
    by_place, by_range = levels(top["place"]), levels(top["part"])
    boxes = items.select(F.col("__at").alias("at"), F.col("__leaf").alias("leaf"), *[F.col(f"__{c}").alias(f"l{c}") for c in _BOX])
    return Tree(items.drop(*[f"__{c}" for c in _BOX]), boxes, leaves, int(top["n"] or 0), int(top["leaves"]), max(by_place, int(by_range == 0)), by_range, capacity, rows)


def _distances() -> tuple[Column, Column]:
    """Least and greatest distance between a point of the asking leaf's box and one of the node's."""
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"n{a}0") - F.col(f"l{a}1"), F.col(f"l{a}0") - F.col(f"n{a}1"))
    span = lambda a: F.greatest(F.col(f"n{a}1") - F.col(f"l{a}0"), F.col(f"l{a}1") - F.col(f"n{a}0"))
    length = lambda f: F.sqrt(f("x") * f("x") + f("y") * f("y"))
    return length(gap), length(span)


def _group(at: Column, size: int) -> Column:
    """The group of ``size`` rows in order, a power of two, that holds a row by its number; groups of a size number on in each range."""
    part, place = F.shiftright(at, _PART), at.bitwiseAND(F.lit((1 << _PART) - 1))
    return F.shiftleft(part, _PART).bitwiseOR(F.shiftright(place, size.bit_length() - 1))


def _key(group: Column, size: int) -> Column:
    return group * 64 + (size.bit_length() - 1)


@dataclass
class Search:
    """What is left to be met of two trees: a row (key, inside, nodes) for each group of asking rows, of one of the sizes."""

    asking: Tree
    held: Tree
    state: DataFrame
    sizes: list[int]
    #: The held rows with their key, where these are fewer than those of the nodes.
    sent: DataFrame | None = None

    @property
    def split(self) -> bool:
        return len(self.sizes) > 1

    def _keyed(self) -> DataFrame:
        """The asking rows with their number and the ``key`` of their group of each size."""
        each = F.array(*[_key(_group(F.col("__at"), n), n) for n in self.sizes])
        return self.asking.items.drop("__leaf").withColumn("key", F.explode(each))

    def rows(self) -> DataFrame:
        """The asking rows, each with the ``key`` it is met by and the number of rows counted ``inside`` for it."""
        return self._keyed().drop("__at").join(self.state.select("key", "inside"), "key")

    def others(self) -> DataFrame:
        """The held rows that a key is to meet, with that key."""
        if self.sent is not None:
            return self.sent
        pairs = self.state.select("key", F.explode("nodes").alias("__other"))
        met = pairs.join(self.held.items.withColumnRenamed("__leaf", "__other"), "__other").drop("__other", "__at")
        return met.select(*[F.col(f"`{c}`").alias(c) for c in met.columns])  # columns of their own beside those of the asking rows

    def met(self) -> DataFrame:
        """Each asking row beside each row it is to meet."""
        n = _tasks(self.state)
        return self.rows().drop("inside").repartition(n, "key").join(self.others().repartition(n, "key"), "key").drop("key")

    def beside(self) -> DataFrame:
        """Each asking row once, with ``inside`` and the array ``others`` of the rows it is to meet, null for none: as many as a few leaves hold."""
        n = _tasks(self.state)
        held = self.others().repartition(n, "key")
        lists = held.groupBy("key").agg(F.collect_list(F.struct(*[f"`{c}`" for c in held.columns if c != "key"])).alias("others"))
        return self.rows().repartition(n, "key").join(lists, "key", "left").drop("key")

    def each(self, answer: Callable[[pa.Table, pa.Table], pa.Table], kind: str, order: str | None = None) -> DataFrame:
        """answer(asking rows of a group in order, what they are to meet) of every group; groups of few rows share a task's batch.

        What is met comes in the order of a column of its, if one is named.
        """
        few = 256  # rows in order whose groups go together

        def lot(key: Column) -> Column:
            group, bits = F.shiftright(key, 6), key.bitwiseAND(F.lit(63)).cast("int")
            first = F.shiftleft(F.shiftright(group, _PART), _PART).bitwiseOR(F.call_function("shiftleft", group.bitwiseAND(F.lit((1 << _PART) - 1)), bits))
            return F.shiftright(first, few.bit_length() - 1)

        def run(own: pa.Table, held: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
            own, held = (t.sort_by([(c, "ascending") for c in by if c]).drop_columns(["__lot"]) for t, by in ((own, ("key", "__at")), (held, ("key", order))))
            keys, starts = np.unique(own["key"].to_numpy(), return_index=True)
            ends, of = np.append(starts[1:], own.num_rows), held["key"].to_numpy()
            first, last = np.searchsorted(of, keys), np.searchsorted(of, keys, "right")
            found = [answer(own.slice(i, j - i), held.slice(a, b - a)) for i, j, a, b in zip(starts, ends, first, last)]
            return pa.table({c: pa.chunked_array([x for t in found for x in (t[c].chunks if isinstance(t[c], pa.ChunkedArray) else [t[c]])], t).cast(t) for c, t in zip(names, types)})

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(kind))
        names, types, n = schema.names, schema.types, _tasks(self.state)
        own = self._keyed().join(self.state.select("key", "inside"), "key")
        own, held = (d.withColumn("__lot", lot(F.col("key"))).repartition(n, "__lot") for d in (own, self.others()))
        return own.groupBy("__lot").cogroup(held.groupBy("__lot")).applyInArrow(run, kind)


def narrowed(xy: np.ndarray, rows: np.ndarray, near: Callable, answer: Callable) -> None:
    """answer(points, rows) for few neighbouring points at a time, by their places in ``xy``, which is in order along a curve.

    near(points, middle, way, rows) gives those rows that any of the points, none farther than ``way`` from the middle, may need.
    """
    todo = [(np.arange(len(xy)), rows)]
    while todo:
        points, rows = todo.pop()
        for part in np.array_split(points, min(16, -(-len(points) // FEW))):
            middle = (xy[part].min(0) + xy[part].max(0)) / 2
            kept = near(part, middle, float(np.sqrt(((xy[part] - middle) ** 2).sum(1)).max()) * (1 + 1e-9), rows)
            if len(part) > FEW:
                todo.append((part, kept))
            else:
                answer(part, kept)


def within_reach(d: np.ndarray, k: int, way: float) -> np.ndarray:
    """Which of the distances from a middle may belong to one of the k nearest of a point so far from it."""
    if len(d) <= k:
        return np.ones(len(d), bool)
    reach = (np.partition(d, k - 1)[k - 1] if k > 1 else d.min()) + 2 * way
    return d <= reach + 1e-9 * (reach + 1)


def needed(boxes: np.ndarray, nodes: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which of the nodes, of n rows each, may hold one of the k nearest rows of a point of any of the boxes. Both are rows of x0, x1, y0, y1;
    the boxes come in order along a curve, so that what sixteen neighbours together don't need is seen once."""
    out = np.zeros(len(nodes), bool)

    def kept(box: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = [np.maximum(0.0, np.maximum(nodes[at, i] - box[i + 1], box[i] - nodes[at, i + 1])) for i in (0, 2)]
        span = [np.maximum(nodes[at, i + 1] - box[i], box[i + 1] - nodes[at, i]) for i in (0, 2)]
        near, far = (np.sqrt(x * x + y * y) for x, y in (gap, span))
        few = min(len(at), k)  # a node has a row at least
        first = np.argpartition(far, few - 1)[:few] if few < len(at) else np.arange(few)
        first = first[np.argsort(far[first], kind="stable")]
        enough = np.searchsorted(np.cumsum(n[at[first]]), k)
        return at[near <= far[first[enough]] * (1 + 1e-9)] if enough < few else at

    for i in range(0, len(boxes), 16) if len(nodes) else ():
        part = boxes[i : i + 16]
        near = kept(np.array([part[:, 0].min(), part[:, 1].max(), part[:, 2].min(), part[:, 3].max()]), np.arange(len(nodes)))
        for box in part:
            out[kept(box, near)] = True
    return out


def compact(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The boxes of every few rows in order, cut where the curve jumps: a box across a jump would be many times as wide as its rows' places."""
    if not rows.num_rows:
        return rows
    at = rows["at"].to_numpy()
    x0, x1, y0, y1 = (rows[c].to_numpy() for c in _BOX[:4])
    first = np.r_[True, at[1:] // FEW != at[:-1] // FEW]  # a range's first number is a multiple of it
    step = np.where(first, 0.0, np.hypot(np.diff(x0 + x1, prepend=0.0), np.diff(y0 + y1, prepend=0.0)))
    starts = np.flatnonzero(first)
    usual = (np.add.reduceat(step, starts) - np.maximum.reduceat(step, starts)) / np.maximum(np.diff(np.r_[starts, len(at)]) - 2, 1)
    starts = np.flatnonzero(first | (step > 4 * np.repeat(usual, np.diff(np.r_[starts, len(at)]))))
    ends = [f.reduceat(v, starts) for f, v in ((np.minimum, x0), (np.maximum, x1), (np.minimum, y0), (np.maximum, y1))]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (at[starts], *ends)], ["at", *_BOX[:4]])


def _tightened(asking: Tree, state: DataFrame, level: DataFrame, sizes: list[int], k: int) -> DataFrame:
    """The state with only those nodes of the level that few neighbouring rows of a group may need for their k nearest; groups of
    few rows stay as they are."""
    large = [size for size in sizes if size > FEW]
    if not large:
        return state
    parts = asking.boxes.select("at", *[F.col(f"l{c}").alias(c) for c in _BOX[:4]]).mapInArrow(lambda batches: map(compact, batches), "at bigint, " + ", ".join(f"{c} double" for c in _BOX[:4]))
    parts = parts.withColumn("key", F.explode(F.array(*[_key(_group(F.col("at"), size), size) for size in large]))).join(state.select("key"), "key", "left_semi")
    is_large = F.col("key").bitwiseAND(F.lit(63)) > FEW.bit_length() - 1
    met = state.filter(is_large).select("key", F.explode("nodes").alias("node")).join(level.select("node", "n", *[F.col(f"n{c}").alias(c) for c in _BOX[:4]]), "node")

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "nodes": pa.array([], pa.list_(pa.int64()))})
        boxes, nodes = (np.column_stack([t[c].to_numpy() for c in _BOX[:4]]) for t in (own.sort_by("at"), held))
        found = held["node"].to_numpy()[needed(boxes, nodes, held["n"].to_numpy(), k)]
        return pa.table({"key": own["key"].slice(0, 1), "nodes": pa.array([found], pa.list_(pa.int64()))})

    n = _tasks(state)
    left = parts.repartition(n, "key").groupBy("key").cogroup(met.repartition(n, "key").groupBy("key")).applyInArrow(run, "key bigint, nodes array<bigint>")
    return state.filter(~is_large).unionByName(state.filter(is_large).drop("nodes").join(left, "key"))


def _descend(asking: Tree, held: Tree, pruned, most: int, tighten: int = 0) -> Search:
    """pruned(found) gives (inside, kept nodes) from the array of (node, n, near, far, first, last) found on a level; with ``tighten``
    only nodes that may hold so many nearest rows of few neighbouring points stay."""
    box, size = [f"l{c}" for c in _BOX], asking.capacity
    state = asking.leaves.select(_key(F.col("node"), size).alias("key"), *[F.col(c).alias(f"l{c}") for c in _BOX], F.lit(0).cast("bigint").alias("inside"), F.array(F.lit(0).cast("bigint")).alias("nodes"))
    state = state.repartition(_tasks(state), "key")
    near, far = _distances()
    found = F.struct("node", "n", near.alias("near"), far.alias("far"), F.col("nv0").alias("first"), F.col("nv1").alias("last"))
    kept, sizes = [*box, "inside"], [size]

    def step(state: DataFrame, level: DataFrame, by: str) -> DataFrame:
        # A key that has no node left keeps its row under a number of its own, so such keys don't meet in one task.
        each = state.select("key", *kept, F.explode_outer("nodes").alias("__to")).withColumn("__to", F.coalesce("__to", -1 - F.col("key")))
        met = each.join(level, F.col("__to") == F.col(by), "left")
        of = met.groupBy("key").agg(*[F.first(c).alias(c) for c in kept], F.collect_list(F.when(F.col("node").isNotNull(), found)).alias("found"))
        inside, nodes = pruned(F.col("found"))
        return of.select("key", *kept[:-1], (F.col("inside") + inside).alias("inside"), nodes.alias("nodes"))

    for k in range(held.height - 1, -1, -1):
        level = held.level(k)
        state = step(state, level, "parent")
        if held.n_leaves >> (FAN_BITS * min(k, held.by_place)) <= most:
            continue  # fewer nodes on this level than a leaf may keep
        state = _settled(state)
        if tighten:
            state = _settled(_tightened(asking, state, level, sizes, tighten))
        for size in sizes:  # grows while groups are split
            wide = state.filter((F.size("nodes") > most) & (F.col("key").bitwiseAND(F.lit(63)) == size.bit_length() - 1))
            n_wide = wide.count() if size > 1 else 0
            if n_wide:
                fewer = max(1, size >> FAN_BITS)
                if fewer not in sizes:
                    sizes.append(fewer)
                of = wide.select("key", "inside", "nodes")
                ends = [(F.min if c[-1] == "0" else F.max)(c).alias(c) for c in box]
                parts = asking.boxes.withColumn("key", _key(_group(F.col("at"), size), size)).join(F.broadcast(of) if n_wide <= FEW_SPLIT else of, "key")  # a checked number of rows
                parts = parts.groupBy(_key(_group(F.col("at"), fewer), fewer).alias("key")).agg(*ends, F.first("inside").alias("inside"), F.first("nodes").alias("nodes"))
                state = _settled(state.join(wide.select("key"), "key", "left_anti").unionByName(step(parts, level, "node")))
    return Search(asking, held, state.select("key", "inside", "nodes", *box), sizes)


def nearest_leaves(asking: Tree, held: Tree, k: int = 1, up_to_value: bool = False, wider: int = 1, beyond: Column | None = None) -> Search:
    """The leaves that hold the k nearest rows of each asking point; all of them if there are fewer than k.

    With ``up_to_value`` only rows whose value is at most the asking point's count: all of a node, or the one of least value.
    With ``beyond`` a group keeps what is so much farther as well; it may name the group's box (lx0, lx1, ly0, ly1).
    """

    def pruned(found: Column) -> tuple[Column, Column]:
        sure = (lambda f: f["first"] <= F.col("lv0")) if up_to_value else (lambda f: F.lit(True))
        number = (lambda f: F.when(f["last"] <= F.col("lv0"), f["n"]).otherwise(1)) if up_to_value else (lambda f: f["n"])
        able = (lambda f: f["first"] <= F.col("lv1")) if up_to_value else (lambda f: F.lit(True))
        by_far = F.array_sort(F.transform(F.filter(found, sure), lambda f: F.struct(f["far"].alias("far"), number(f).alias("n"))))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(float("inf")).alias("far"))
        step = lambda s, f: F.struct((s["n"] + f["n"]).alias("n"), F.when(s["n"] < k, f["far"]).otherwise(s["far"]).alias("far"))
        reach = F.aggregate(by_far, start, step, lambda s: F.when(s["n"] < k, F.lit(float("inf"))).otherwise(s["far"]))
        # A one-element array holds the reach, so that it is worked out once and not for each node.
        near = F.transform(F.array(reach * (1 + 1e-9) + (F.lit(0.0) if beyond is None else beyond)), lambda r: F.filter(found, lambda f: able(f) & (f["near"] <= r)))[0]
        return F.lit(0).cast("bigint"), F.transform(near, lambda f: f["node"])

    return _descend(asking, held, pruned, wider * MOST_NODES + 4 * k // SMALL, k if asking.capacity > FEW and not up_to_value and beyond is None else 0)


def leaves_within(asking: Tree, held: Tree, radius: float, whole: bool = True, wider: int = 1) -> Search:
    """The leaves that may hold rows within the radius, beside the number ``inside`` of rows in nodes that lie within it as a whole.

    Without ``whole`` no node is counted unseen.
    """
    r = F.lit(float(radius))

    def pruned(found: Column) -> tuple[Column, Column]:
        near = F.filter(found, lambda f: f["near"] <= r)
        if not whole:
            return F.lit(0).cast("bigint"), F.transform(near, lambda f: f["node"])
        inside = F.aggregate(F.filter(near, lambda f: f["far"] <= r), F.lit(0).cast("bigint"), lambda s, f: s + f["n"])
        return inside, F.transform(F.filter(near, lambda f: f["far"] > r), lambda f: f["node"])

    return _descend(asking, held, pruned, wider * MOST_NODES)

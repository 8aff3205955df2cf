"""Benchmark decontamination by a positional inverted index of the training text.

Indexing: each task turns its documents into segments of a bounded number of words. A segment holds its terms and, for
each, the sorted positions where it stands; it is one row of a table in the shared folder, so the index is as
distributed as its segments, built without a shuffle, and survives lost executors. A document longer than a segment is
a segment of its own.

Searching: every segment takes the test windows, block by block. From the rarest of a window's terms in that segment,
the postings of the others are intersected, moved by their offsets, until no start is left; the starts that stay are
exact phrase matches. Proximity matches are found the same way, from the rarest term outwards: the terms in order, with
at most ``slack`` other words between neighbours. Words inside an exact match are hit; words from the first to the last
word of a proximity match (exact ones are such, too) are near.

Test windows are cut and merged by Spark and come to the driver and out to the tasks one block at a time: a block holds
about ``BLOCK_WINDOWS`` windows and their words, so what is broadcast has a bound that does not grow with the benchmark.

Null and empty texts have no words: n_words, n_hit and n_near 0, not contaminated. Items with null text or id, or
without words, are no items; an empty id is an id like others. Repeated items count once by id. Repeated documents are
judged alike, each in a row of its own. Texts of any length are read whole. Other columns are not read. An empty table of
documents gives an empty result, one of items no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table

WINDOW = 13
#: Other words allowed between neighbouring words of a proximity match.
SLACK = 2
SEGMENT_WORDS = 1_000_000
BLOCK_WINDOWS = 100_000
#: Positions left empty between the documents of a segment; proximity matches can't cross it.
DOCUMENT_GAP = 64
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The contract's words, as UTF-8: A to Z lower-cased; digits, letters and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Windows:
    """A block of windows: their vocabulary, word numbers by window, and the items each window belongs to."""

    vocabulary: list[bytes]
    terms: list[np.ndarray]
    items: list[list[str]]


def cut_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows of (item_id, text), words joined by blanks, and the ids of their items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, ids = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    made.append(b" ".join(w[i : i + window]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(ids, pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(cut, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items"))


def blocks_of(windows: DataFrame, size: int) -> Iterator[Windows]:
    """The windows in blocks of about ``size``, one at a time."""
    number = max(1, -(-windows.count() // size))
    for b in range(number):
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(number)) == b).collect()  # about ``size`` rows
        vocabulary: dict[bytes, int] = {}
        terms = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in bytes(r["window"]).split(b" ")], np.int64) for r in rows]
        yield Windows(list(vocabulary), terms, [sorted(r["items"]) for r in rows])


class Numbered(dict):
    """Numbers of keys in order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


INDEX_SCHEMA = "segment string, doc_ids binary, doc_nulls binary, doc_starts binary, doc_words binary, terms array<binary>, term_starts binary, positions binary"


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments over (doc_id, text) rows; positions run on through a segment's documents, a gap between them."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), count()
        vocabulary = Numbered()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        starts: list[int] = [0]

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            term = np.concatenate(ids) if ids else np.empty(0, np.int32)
            place = np.arange(len(term), dtype=np.int64) + np.repeat(np.array(starts[:-1]) - (np.cumsum(lengths) - lengths), lengths)
            order = np.argsort(term, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
            row = {
                "segment": pa.array([f"{task}-{next(numbers)}"], pa.string()),
                "doc_ids": pa.array([np.array([k if k is not None else 0 for k in keys], np.int64).tobytes()], pa.binary()),
                "doc_nulls": pa.array([np.array([k is None for k in keys], np.bool_).tobytes()], pa.binary()),
                "doc_starts": pa.array([np.array(starts, np.int64).tobytes()], pa.binary()),
                "doc_words": pa.array([lengths.tobytes()], pa.binary()),
                "terms": pa.array([list(vocabulary)], pa.list_(pa.binary())),
                "term_starts": pa.array([first.astype(np.int64).tobytes()], pa.binary()),
                "positions": pa.array([place[order].astype(np.int32).tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                if keys and starts[-1] + len(w) > segment_words:
                    yield flush()
                    vocabulary, ids, keys, starts = Numbered(), [], [], [0]
                ids.append(np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)))
                keys.append(key)
                starts.append(starts[-1] + len(w) + DOCUMENT_GAP)
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(segments, INDEX_SCHEMA)


class Segment:
    """One row of the index."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["doc_nulls"], np.bool_)
        self.starts = np.frombuffer(row["doc_starts"], np.int64)
        self.lengths = np.frombuffer(row["doc_words"], np.int64)
        self.number = {w: i for i, w in enumerate(row["terms"])}
        self.first = np.frombuffer(row["term_starts"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase; the gap between documents keeps matches inside one."""
        lists = sorted(((len(p := self.postings(int(t))), k, p) for k, t in enumerate(terms)), key=lambda x: x[:2])
        starts = lists[0][2] - lists[0][1]
        for _, k, p in lists[1:]:
            starts = starts[held(p, starts + k)]
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the proximity matches through each occurrence of the rarest term: its earliest start and latest end."""
        lists = [self.postings(int(t)) for t in terms]
        rarest = min(range(len(lists)), key=lambda k: len(lists[k]))
        after, last = outward(lists[rarest], lists[rarest + 1 :], slack, 1)
        before, first = outward(lists[rarest][after], lists[:rarest][::-1], slack, -1)
        return first, last[before] + 1

    def add(self, spans: dict[int, list[tuple[int, int]]], begin: np.ndarray, end: np.ndarray) -> list[int]:
        """Spans by document, counted from its first word; returns the documents."""
        at = np.searchsorted(self.starts, begin, side="right") - 1
        for d, s, e in zip(at.tolist(), (begin - self.starts[at]).tolist(), (end - self.starts[at]).tolist()):
            spans.setdefault(d, []).append((s, e))
        return sorted(set(at.tolist()))


def held(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    return (at < len(sorted_list)) & (sorted_list[np.minimum(at, len(sorted_list) - 1)] == values)


def outward(places: np.ndarray, lists: list[np.ndarray], slack: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the places from which all lists can be passed in turn, each step 1 to slack + 1 positions in the direction
    of the sign, and the farthest position reached from each."""
    origin, at = np.arange(len(places)), places
    steps = sign * np.arange(1, slack + 2)
    for p in lists:
        to = (at[:, None] + steps).ravel()
        origin = np.repeat(origin, len(steps))
        ok = held(p, to)
        to, origin = to[ok], origin[ok]
        if not len(to):
            return origin, to
        order = np.lexsort((sign * to, origin))
        to, origin = to[order], origin[order]
        new = np.concatenate([[True], (to[1:] != to[:-1]) | (origin[1:] != origin[:-1])])
        at, origin = to[new], origin[new]
    last = np.concatenate([origin[1:] != origin[:-1], [True]]) if len(origin) else np.empty(0, bool)
    return origin[last], at[last]


HITS_SCHEMA = "segment string, ordinal int, doc_id long, n_words long, spans binary, near binary, items array<string>"


def search(index: DataFrame, block: Windows, slack: int, every: bool) -> DataFrame:
    """Per document of the index with a match, or per document: its number of words, the merged spans of hit and of near
    words, and the items found."""
    shared = index.sparkSession.sparkContext.broadcast(block)  # about BLOCK_WINDOWS windows

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        cuts = np.cumsum([0, *map(len, windows.terms)])
        flat = np.concatenate([np.empty(0, np.int64), *windows.terms])
        for batch in batches:
            for at_row in range(batch.num_rows):  # a segment at a time, so that a batch is never all Python objects at once
                row = batch.slice(at_row, 1).to_pylist()[0]
                seg = Segment(row)
                spans: dict[int, list[tuple[int, int]]] = {}
                near: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                local = np.array([seg.number.get(w, -1) for w in windows.vocabulary], np.int64)
                numbers = local[flat] if len(flat) else flat
                missing = np.concatenate([[0], np.cumsum(numbers < 0)])
                for k in np.flatnonzero(missing[cuts[1:]] == missing[cuts[:-1]]):
                    q = numbers[cuts[k] : cuts[k + 1]]
                    begin, end = seg.near(q, slack)
                    if not len(begin):
                        continue
                    seg.add(near, begin, end)
                    begin = seg.phrase(q)
                    for d in seg.add(spans, begin, begin + len(q)):
                        items.setdefault(d, set()).update(windows.items[k])
                rows = range(len(seg.docs)) if every else sorted(near)
                packed = lambda x: pa.array([np.array(merge_spans(x[d]), np.int64).tobytes() if d in x else b"" for d in rows], pa.binary())  # noqa: E731,B023
                at = np.array(rows, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([row["segment"]] * len(at), pa.string()),
                        "ordinal": pa.array(at.astype(np.int32)),
                        "doc_id": pa.array(seg.docs[at], pa.int64(), mask=seg.nulls[at]),
                        "n_words": pa.array(seg.lengths[at]),
                        "spans": packed(spans),
                        "near": packed(near),
                        "items": pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string())),
                    }
                )

    return index.mapInArrow(searched, HITS_SCHEMA)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def summary(parts: DataFrame, several: bool) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and n_near per document; parts of several blocks are merged first."""
    if several:
        parts = parts.groupBy("segment", "ordinal").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("near").alias("near"), F.flatten(F.collect_list("items")).alias("items")
        )
    else:
        parts = parts.withColumns({"spans": F.array("spans"), "near": F.array("near")})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {"spans": [], "near": []}
            for name, numbers in made.items():
                for spans in batch.column(name).to_pylist():
                    every = [tuple(x) for b in spans for x in np.frombuffer(b, np.int64).reshape(-1, 2).tolist()]
                    numbers.append(sum(e - s for s, e in merge_spans(every)))
            ids = [sorted(set(x)) for x in batch.column("items").to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(made["spans"], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(digest, pa.string()), pa.array(made["near"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_near"])

    made = parts.select("doc_id", "n_words", "spans", "near", "items").mapInArrow(counted, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, n_near long")
    verdict = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", verdict.alias("contaminated"), "n_near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK, block_windows: int = BLOCK_WINDOWS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per document (doc_id, text) with the contract's columns and n_near, the words inside proximity matches.

    The windows of the test items are the stated query set against all documents, in blocks.
    """
    if not 0 <= slack < DOCUMENT_GAP - 1:
        raise ValueError(f"slack must be from 0 to {DOCUMENT_GAP - 2}")
    scratch = Scratch(docs.sparkSession, "contamination")
    windows = scratch.write(cut_windows(benchmark, window), "windows")
    index = scratch.write(build_index(docs, segment_words), "index")
    parts = [search(index, b, slack, i == 0) for i, b in enumerate(blocks_of(windows, block_windows))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return summary(union, len(parts) > 1)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(table(spark, sf_dir, "benchmark"), item_id="item_id", text="text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), inputs(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated.

    The index is keyed by a hash of id and text here, so that a verdict falls on that text alone.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    judged = decontaminate(keyed.select(F.col("__row").alias("doc_id"), "text"), inputs(spark, sf_dir))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(bad, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, w[i:i + least(len(w), {WINDOW}) - 1] AS ws FROM b, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
h AS (SELECT rid, n, i, item FROM dw JOIN (SELECT item, n, array_to_string(ws, ' ') AS win FROM bw) USING (n, win)),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(h.n)) t(k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid),
x AS (SELECT DISTINCT ws, n FROM bw),
y AS (SELECT row_number() OVER () AS q, ws, n FROM x),
o AS (SELECT rid, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
c AS (SELECT q, rid, 1 AS k, i AS s, i AS p FROM y JOIN o ON o.word = ws[1]
  UNION SELECT c.q, c.rid, c.k + 1, c.s, c.p + g FROM c JOIN y USING (q) JOIN d USING (rid), unnest([{", ".join(str(g) for g in range(1, SLACK + 2))}]) t(g) WHERE c.k < y.n AND d.w[c.p + g] = y.ws[c.k + 1]),
nr AS (SELECT DISTINCT c.rid, s, p FROM c JOIN y USING (q) WHERE c.k = y.n),
nn AS (SELECT rid, count(DISTINCT j) AS n_near FROM nr, unnest(range(s, p + 1)) t(j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid) LEFT JOIN nn USING (rid)
"""

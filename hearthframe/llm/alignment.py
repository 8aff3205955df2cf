"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes.

Both tokenizers encode space+text. Each byte gets a label: no token ends here, one of A, one of B, or one of both. A regular
expression scans the label string and takes spans up to each both-label; a span's labels count the tokens of its group.
``align`` gives ids, byte ends and group sizes of every text; ``link_statistics`` counts over all texts in how many of them an
A id and a B id share a group, and holds each text's links against those counts.

Counting: the texts of a task are put in blocks of bounded size that hold each linked id pair once. Only these distinct pairs
are shuffled, with the number of texts in the block that hold them, so a pair in every text costs one row a block and not one a
text. The blocks are a written table, so a lost executor repeats tasks of it and not the encoding. A block is written in slices
of bounded size and read a few slices at a time, and its counts come back to it as rows, so no executor holds many blocks at once.

Texts that are null or empty, or whose joined token bytes differ from space+text under either tokenizer, have no tokens and
no groups. Whole texts are encoded, of any length; the memory of a task grows with its longest text and that text's distinct
links. Repeated rows, and rows without id, count as rows of their own. An empty table gives an empty result. Other columns of the
input are not read. Tokenizer files are read where they lie on each machine (``folder``); nothing is trained.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table

FOLDER = "/opt/tokenizers"
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_ENTRIES, MOST_TEXTS, LOT = 1 << 19, 2048, 1 << 16
#: Entries of a slice of a block, and slices that a task reads at once.
SLICE, SLICES_AT_ONCE = 1 << 15, 32
#: A run without a space longer than this goes to the library whose merges don't slow down on long runs.
LONG_RUN = 20_000
LABELS = np.frombuffer(b".ab|", np.uint8)
SPAN = re.compile(rb"[.ab]*\|")

# ---- Fixed values: the split pattern and the bytes that stand for themselves in byte-level vocabularies. ----
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
# ---- End of fixed values. ----


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printed bytes themselves, the others from U+0100 on."""
    shown = [b for lo, hi in PRINTED for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Tokenizer A: byte-level pairs from a vocabulary file.

    Where ids follow the order of the merges, as they do in the given file, ids are merge ranks and the faster of the two
    libraries runs them; texts with very long runs, and other vocabularies, are run by the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        letters = byte_letters()
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        vocabulary = {k: i for k, i in model["vocab"].items() if k not in special}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for k, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in k)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        self.ranked = None
        if ordered:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.long = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))

    def ids(self, text: str) -> list[int]:
        spaced = " " + text
        if self.ranked and not (len(spaced) > LONG_RUN and self.long.search(spaced)):
            return self.ranked.encode_ordinary(spaced)
        return self.own.encode(spaced, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer B: pieces with byte fallback; it adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.own.get_piece_size()
        byte = lambda i: bytes([int(self.own.id_to_piece(i)[3:-1], 16)])
        self.bytes = [byte(i) if self.own.is_byte(i) else self.own.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: str) -> list[int]:
        return self.own.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def tokenizers_of(folder: str) -> tuple[ByteTokens, PieceTokens]:
    """Read once a worker."""
    return ByteTokens(os.path.join(folder, BYTES_FILE)), PieceTokens(os.path.join(folder, PIECES_FILE))


def label_string(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """A label for each byte: ``.`` none, ``a`` a token of A ends here, ``b`` one of B, ``|`` both."""
    code = np.zeros(size, np.uint8)
    code[ends_a - 1] = 1
    code[ends_b - 1] |= 2
    return LABELS[code].tobytes()


def spans(labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, n_a, n_b) of every span up to a both-label: its byte end and the tokens of A and of B that end in it."""
    lengths = np.fromiter(map(len, SPAN.findall(labels)), np.int64)
    if not len(lengths):
        return lengths, lengths, lengths
    ends = np.cumsum(lengths)
    held = np.frombuffer(labels, np.uint8)[: ends[-1]]
    both = held == LABELS[3]
    count = lambda letter: np.add.reduceat(((held == letter) | both).astype(np.int64), ends - lengths)
    return ends, count(LABELS[1]), count(LABELS[2])


Tokens = tuple[np.ndarray, np.ndarray, int]
NONE = (np.empty(0, np.int32), np.empty(0, np.int32), 0)


def tokens_of(text: str | None, a: ByteTokens, b: PieceTokens) -> Tokens:
    """A ids, B ids and the number of bytes of a text; nothing for a text without tokens."""
    if not text:
        return NONE
    raw = b" " + text.encode("utf-8", "surrogatepass")
    ids_b = b.ids(text)
    if b"".join(map(b.bytes.__getitem__, ids_b)) != raw:
        return NONE
    ids_a = np.asarray(a.ids(text), np.int32)
    # Ranked merges cut the text's own bytes, so their number tells whether any is missing; it holds for both libraries by test.
    if int(a.sizes[ids_a].sum()) != len(raw):
        return NONE
    return ids_a, np.array(ids_b, np.int32), len(raw)


@dataclass
class Lot:
    """Texts aligned together: ids, and group ends and sizes, one text after the other; text i has those from cut i to cut i + 1."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut: np.ndarray


def _cuts(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def align_lot(tokens: list[Tokens], a: ByteTokens, b: PieceTokens) -> Lot:
    """One label string for all texts of the lot: both tokenizers end a token where a text ends, so no group crosses two texts."""
    ids_a, ids_b = (np.concatenate([t[i] for t in tokens]) for i in (0, 1))
    bytes_cut = _cuts([t[2] for t in tokens])
    ends, size_a, size_b = spans(label_string(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), int(bytes_cut[-1])))
    cut = np.searchsorted(ends, bytes_cut, side="right")
    return Lot(ids_a, ids_b, ends - np.repeat(bytes_cut[:-1], np.diff(cut)), size_a, size_b, _cuts([len(t[0]) for t in tokens]), _cuts([len(t[1]) for t in tokens]), cut)


def lots(texts: pa.Array, a: ByteTokens, b: PieceTokens, most_texts: int) -> Iterator[tuple[int, int, Lot]]:
    """(first, end, lot) of a column's texts, at most ``most_texts`` and about ``LOT`` tokens at a time; a longer text is a lot of its own."""
    first, held, n = 0, [], 0
    for i in range(len(texts)):
        held.append(tokens_of(texts[i].as_py(), a, b))
        n += len(held[-1][0]) + len(held[-1][1])
        if n >= LOT or len(held) >= most_texts:
            yield first, i + 1, align_lot(held, a, b)
            first, held, n = i + 1, [], 0
    if held:
        yield first, len(texts), align_lot(held, a, b)


def align(docs: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER) -> DataFrame:
    """The kept columns of every row with ``a``, ``b`` (ids), ``ends`` (byte offsets in space+text where groups end), ``size_a``
    and ``size_b`` (tokens of each group); empty arrays for a text without tokens. No shuffle."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(folder)
        for batch in batches:
            for first, end, lot in lots(batch.column(batch.num_columns - 1), a, b, MOST_TEXTS):
                of = lambda cut, values, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, kind))
                lists = [of(lot.cut_a, lot.a, pa.int32()), of(lot.cut_b, lot.b, pa.int32()), of(lot.cut, lot.ends, pa.int64()), of(lot.cut, lot.size_a, pa.int32()), of(lot.cut, lot.size_b, pa.int32())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, end - first) for i in range(len(keep))], *lists], names=[*keep, "a", "b", "ends", "size_a", "size_b"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, a array<int>, b array<int>, ends array<bigint>, size_a array<int>, size_b array<int>")


def links(lot: Lot, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, times, cuts): of each text the id pairs that share a group (A id * 2^32 + B id), each once, and in how many pairs of
    token occurrences. Large groups are counted by their distinct ids, the others ``most`` links at a time."""
    na, nb = lot.size_a, lot.size_b
    total = na * nb
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    owner = np.repeat(np.arange(len(lot.cut) - 1), np.diff(lot.cut))
    low = 16 if not len(lot.b) else max(1, int(lot.b.max()).bit_length())
    high = low + (1 if not len(lot.a) else max(1, int(lot.a.max()).bit_length()))
    code = lambda text, a, b: (text << high) | (a.astype(np.int64) << low) | b.astype(np.int64)
    codes, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for g in np.flatnonzero(total > 4096).tolist():
        ua, ca = np.unique(lot.a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(lot.b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        codes.append(code(int(owner[g]), ua[:, None], ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
    small = np.flatnonzero((total > 0) & (total <= 4096))
    done = np.cumsum(total[small])
    for part in np.split(small, np.searchsorted(done, np.arange(most, int(done[-1]) if len(done) else 0, most))):
        if not len(part):
            continue
        # A row for each token of A, then one for each token of B in its group.
        n = na[part]
        token_a = np.repeat(start_a[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        fan = np.repeat(nb[part], n)
        token_b = np.repeat(np.repeat(start_b[part], n) - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
        k, c = np.unique(code(np.repeat(np.repeat(owner[part], n), fan), np.repeat(lot.a[token_a], fan), lot.b[token_b]), return_counts=True)
        codes.append(k)
        times.append(c)
    key, n = np.concatenate(codes), np.concatenate(times)
    if len(codes) > 2:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
    cuts = np.searchsorted(key >> high, np.arange(len(lot.cut)))
    ids = ((key >> low & ((1 << (high - low)) - 1)) << 32) | (key & ((1 << low) - 1))
    return ids, n, cuts


class GroupText:
    """The groups of texts as ``a1,a2|b1;a3|b2,b3``: each token with the mark that follows it, put in order by its group."""

    def __init__(self, size_a: int, size_b: int):
        marked = [f"{i}{m}".encode() for n, m in ((size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")) for i in range(n)]
        self.width = np.array([len(m) for m in marked], np.int64)
        self.letters = np.frombuffer(b"".join(m.ljust(int(self.width.max())) for m in marked), np.uint8).reshape(len(marked), -1)
        self.n_a, self.n_b = size_a, size_b

    def __call__(self, lot: Lot) -> list[bytes]:
        done_a, done_b = np.cumsum(lot.size_a), np.cumsum(lot.size_b)
        last_a, last_b = np.zeros(len(lot.a), np.int64), np.zeros(len(lot.b), np.int64)
        last_a[done_a - 1] = last_b[done_b - 1] = 1
        code = np.empty(len(lot.a) + len(lot.b), np.int64)
        code[np.arange(len(lot.a)) + np.repeat(done_b - lot.size_b, lot.size_a)] = lot.a + last_a * self.n_a
        code[np.arange(len(lot.b)) + np.repeat(done_a, lot.size_b)] = lot.b + 2 * self.n_a + last_b * self.n_b
        width = self.width[code]
        shown = self.letters[code][np.arange(self.letters.shape[1]) < width[:, None]].tobytes()
        cut = _cuts(width)[lot.cut_a + lot.cut_b].tolist()
        return [shown[i : max(i, j - 1)] for i, j in zip(cut[:-1], cut[1:])]


BLOCK = "block bigint, first int, doc array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, upto array<int>, pair array<int>, times array<bigint>, keys array<bigint>, texts array<int>"


def link_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = FOLDER, most_entries: int = MOST_ENTRIES, most_texts: int = MOST_TEXTS, most_slice: int = SLICE) -> DataFrame:
    """Blocks of texts as sparse rows over the block's distinct id pairs (``keys``, in ``texts`` texts of it each): of text i,
    pairs ``pair[upto[i-1]:upto[i]]`` with their numbers of links, next to its counts and digest. A block is one or more rows, each
    with about ``most_slice`` entries of its texts and of its pairs, of which its first has the number ``first``. No shuffle."""
    rows = only(docs, doc=doc, text=text).withColumn("doc", F.col("doc").cast("bigint"))

    def block(held: list[list], number: int) -> Iterator[pa.RecordBatch]:
        docs, n_a, n_b, n_groups, n_links, sha, sizes, keys, times = zip(*held)
        docs, sha = list(chain.from_iterable(docs)), list(chain.from_iterable(sha))
        counted = [np.concatenate(x) for x in (n_a, n_b, n_groups, n_links)]
        keys, pair = np.unique(np.concatenate(keys), return_inverse=True)
        texts, times, upto = np.bincount(pair, minlength=len(keys)), np.concatenate(times), _cuts(np.concatenate(sizes))
        ends = [i for i in range(1, len(docs)) if upto[i] // most_slice > upto[i - 1] // most_slice]  # where the entries so far pass a multiple
        cuts = [0, *ends, len(docs)]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        for span, first in zip_longest(zip(cuts[:-1], cuts[1:]), range(0, len(keys), most_slice)):
            i, j = span or (0, 0)
            k = slice(first, first + most_slice) if first is not None else slice(0, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([first or 0], pa.int32()), one(docs[i:j], pa.int64()), *[one(x[i:j], pa.int64()) for x in counted], one(sha[i:j], pa.string()), one(upto[i + 1 : j + 1] - upto[i], pa.int32())]
                + [one(pair[upto[i] : upto[j]].astype(np.int32), pa.int32()), one(times[upto[i] : upto[j]], pa.int64()), one(keys[k], pa.int64()), one(texts[k], pa.int32())],
                names=[c.split()[0] for c in BLOCK.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(folder)
        shown = GroupText(len(a.bytes), len(b.bytes))
        held, entries, texts, number = [], 0, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, column = batch.columns
            for first, end, lot in lots(column, a, b, most_texts):
                keys, times, cuts = links(lot)
                counted = [np.diff(c) for c in (lot.cut_a, lot.cut_b, lot.cut)] + [np.diff(_cuts(times)[cuts])]
                sha = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(shown(lot), counted[2].tolist())]
                held.append([ids.slice(first, end - first).to_pylist(), *counted, sha, np.diff(cuts), keys, times])
                entries, texts = entries + len(keys), texts + end - first
                if entries >= most_entries or texts >= most_texts:
                    yield from block(held, number)
                    held, entries, texts, number = [], 0, 0, number + 1
        if held:
            yield from block(held, number)

    return rows.mapInArrow(run, BLOCK)


def link_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """Each row's id with n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many texts as its A id's most frequent
    pair), count_sum (over links, the texts that hold the pair) and groups_sha256.

    Two shuffles of the blocks' distinct pairs by pair, one of the counts by A id (an A id has at most as many pairs as B has
    ids), one of counts and slices by block, all of rows of bounded size; a task holds one block's counts, which are bounded.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.write(link_blocks(docs, doc, text, folder), "blocks", rows_a_group=SLICES_AT_ONCE)
    pairs = blocks.select("block", "first", F.posexplode(F.arrays_zip("keys", "texts")).alias("at", "p")).select("block", (F.col("first") + F.col("at")).alias("at"), F.col("p.keys").alias("key"), "p.texts")
    counts = pairs.groupBy("key").agg(F.sum("texts").alias("count"))
    known = counts.select("key", "count", (F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("key", 32)))).alias("best"))
    back = pairs.join(known, "key").select(F.col("block").alias("of"), "at", "count", "best")
    read = blocks.select("block", "doc", "n_a", "n_b", "n_groups", "n_links", "sha", "upto", "pair", "times").filter(F.size("doc") > 0)

    def finish(of: pa.Table, slices: pa.Table) -> pa.Table:
        at = of.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at], best[at] = of.column("count").to_numpy(), of.column("best").to_numpy()
        made = []
        for batch in slices.to_batches():
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values for n in batch.schema.names[1:]}
                upto, pair, times = (row[n].to_numpy() for n in ("upto", "pair", "times"))
                total = lambda each: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(each)])[upto]]))
                sums = [total(times * best[pair]), total(times * count[pair])]
                made.append(pa.RecordBatch.from_arrays([row["doc"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *[pa.array(s, pa.int64()) for s in sums], row["sha"]], names=[c.split()[0] for c in RESULT.split(", ")]))
        return pa.Table.from_batches(made)

    return back.groupBy("of").cogroup(read.groupBy("block")).applyInArrow(finish, RESULT)


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents"))

"""Importance resampling against a plain version by the contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from hearthframe.llm import resampling as R
from hearthframe.llm.common import Remembered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets=10_000, longest=1, least=20, percent=10):
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(t, longest)]
    features = [of(t) for _, t in docs]
    s, t = Counter(b for f in features for b in f), Counter(b for x in target for b in of(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for (i, _), f in zip(docs, features):
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows))


def texts(n, seed=4):
    rng = random.Random(seed)
    words = ["alpha", "BETA", "éa", "x1", "gamma", "delta", "ñ", "zeta9"]
    out = [None, "", "...", "one", "a,b;c", "K" * 3000, "É É"]
    out += [" ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + ["same words in many rows " * 6] * 30


@pytest.mark.parametrize("percent, longest, buckets", [(10, 1, 10_000), (100, 2, 97), (0, 3, 500)])
def test_rows_against_a_plain_version(spark, percent, longest, buckets):
    docs = list(enumerate(texts(200)))
    target = ["alpha alpha beta11 éa", None, "", "gamma x1 x1"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, weight string").repartition(6)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(d, b, buckets=buckets, longest=longest, percent=percent)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, target, buckets, longest, percent=percent)


def test_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "w " * 30)] * 40 + [(None, "v " * 30)] * 40, "doc_id bigint, text string").repartition(4)
    b = spark.createDataFrame([], "text string")
    rows = R.resample(d, b, percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 41))
    assert R.resample(d.limit(0), b).count() == 0


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    rng = random.Random(2)
    for n in (1, 2, 3):
        text = "".join(rng.choice("abé Z9.") for _ in range(3000))
        known = Remembered(lambda f: zlib.crc32(f) % 1000, 10)
        monkeypatch.setattr(R.pieces, "__defaults__", (7,))
        got = R.text_buckets(text, known, n)
        assert Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 1000 for f in runs(text, n))


def test_blocks_are_bounded_and_hold_every_row(spark):
    docs = spark.createDataFrame(list(enumerate(texts(100))), "doc_id bigint, text string").repartition(2)
    blocks = R.count_matrix(docs, "doc_id", most_rows=9, most_entries=60).collect()
    assert sum(len(b["doc"]) for b in blocks) == docs.count() and all(len(b["doc"]) <= 9 for b in blocks)
    assert sum(sum(b["times"]) for b in blocks) == sum(sum(b["n"]) for b in blocks) == sum(len(runs(t, 1)) for t in texts(100))
    assert R.column_sums(spark.createDataFrame(blocks, R.MATRIX)).sum() == np.sum([sum(b["n"]) for b in blocks])


def test_a_reader_of_the_matrix_unpacks_few_blocks_at_once(spark, monkeypatch):
    """Blocks by default, and row groups of the written matrix, are bounded: all blocks of a file at once fill an executor."""
    import pyarrow.parquet as pq

    assert R.MOST_ENTRIES * R.BLOCKS_AT_ONCE * 8 <= 1 << 24
    monkeypatch.setattr(R.Scratch, "drop", lambda self, *names: made.append(f"{self.root}/matrix"))
    monkeypatch.setattr(R.count_matrix, "__defaults__", (*R.count_matrix.__defaults__[:-2], 2, 1 << 15))
    made = []
    docs = spark.createDataFrame([(i, "w x y " * 9) for i in range(400)], "doc_id bigint, text string").coalesce(1)
    assert R.resample(docs, docs.limit(1)).count() == 400
    files = [f for f in Path(made[0].removeprefix("file:")).iterdir() if f.suffix == ".parquet"]
    groups = [m.row_group(i).num_rows for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert sum(groups) == 200 and max(groups) <= R.BLOCKS_AT_ONCE

"""Cross-tokenizer alignment against a plain version that walks the tokens of both tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import alignment as A

ODD = [None, "", " ", "  two  spaces\n\n", "naïve café 😀😀 日本語", "<|endoftext|> and <s> are text", "a▁b", "x" * 6000 + " " * 6000 + "y", "\x00\t\r", "ﬁ ligature ½", "1234567890" * 30, "don't we'll"]


def plain(texts):
    """Rows by the contract, token by token, with the vocabulary file's own library for A."""
    a_side, b_side = A.tokenizers_of(A.FOLDER)
    rows, linked = [], Counter()
    for text in texts:
        groups = []
        if text:
            raw = b" " + text.encode()
            a, b = a_side.own.encode(" " + text, add_special_tokens=False).ids, b_side.own.encode(text)
            if b"".join(a_side.bytes[i] for i in a) == raw == b"".join(b_side.bytes[i] for i in b):
                i = j = done_a = done_b = 0
                held_a, held_b = [], []
                while i < len(a) or j < len(b):
                    if j >= len(b) or (i < len(a) and done_a <= done_b):
                        held_a.append(a[i])
                        done_a += len(a_side.bytes[a[i]])
                        i += 1
                    else:
                        held_b.append(b[j])
                        done_b += len(b_side.bytes[b[j]])
                        j += 1
                    if done_a == done_b:
                        groups.append((held_a, held_b))
                        held_a, held_b = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        linked.update(links.keys())
        rows.append((groups, links))
    top = defaultdict(int)
    for (x, _), n in linked.items():
        top[x] = max(top[x], n)
    out = []
    for groups, links in rows:
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if linked[k] == top[k[0]]),
            sum(n * linked[k] for k, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "shed", "ation", "Über", "ciónñ", "don't", "42", "2,000", "…", "語", "  ", "\n", "x1y2", "thereandback"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_links_against_a_walk_over_tokens(spark):
    texts = ODD + random_texts(150) + ["again and again"] * 40
    docs = spark.createDataFrame([(i if i != 20 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_a string").repartition(5)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in A.link_statistics(docs).collect())
    assert got == sorted(plain(texts))
    assert A.link_statistics(docs.limit(0)).count() == 0


@pytest.mark.parametrize("entries, texts", [(1, 1), (50, 7), (1 << 19, 2048)])
def test_blocks_of_any_size_hold_the_same_links(spark, entries, texts):
    docs = spark.createDataFrame(list(enumerate(random_texts(60))), "doc_id bigint, text string").repartition(3)
    blocks = A.link_blocks(docs, most_entries=entries, most_texts=texts).collect()
    counts = Counter()
    for b in blocks:
        assert len(b["doc"]) < 2 * texts and len(set(b["keys"])) == len(b["keys"])
        counts.update(dict(zip(b["keys"], b["texts"])))
    want = Counter()
    for r in A.align(docs, ["doc_id"]).collect():
        i = j = 0
        pairs = set()
        for n, m in zip(r["size_a"], r["size_b"]):
            pairs |= {(x << 32) | y for x in r["a"][i : i + n] for y in r["b"][j : j + m]}
            i, j = i + n, j + m
        want.update(pairs)
    assert counts == want and sum(len(b["doc"]) for b in blocks) == 60


def test_a_block_is_written_in_slices_of_bounded_size(spark, monkeypatch):
    """A block of all its pairs in one row is unpacked, and gathered again, whole: many of them fill an executor."""
    texts = [None, ""] + random_texts(80) + ["..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)
    most = max(len(b["pair"]) for b in A.link_blocks(docs, most_texts=1).collect())
    rows = A.link_blocks(docs, most_slice=100).collect()
    assert len({r["block"] for r in rows}) == 1 and len(rows) > 10
    assert all(len(r["keys"]) <= 100 and len(r["pair"]) < 100 + most for r in rows)
    monkeypatch.setattr(A.link_blocks, "__defaults__", (*A.link_blocks.__defaults__[:-1], 100))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in A.link_statistics(docs).collect()) == sorted(plain(texts))


def test_spans_end_at_labels_of_both():
    labels = A.label_string(np.array([2, 3, 6, 9]), np.array([3, 4, 5, 9]), 9)
    assert labels == b".a|bba..|"
    assert [x.tolist() for x in A.spans(labels)] == [[3, 9], [2, 2], [1, 3]]


@pytest.mark.parametrize("most", [1, 64, 1 << 22])
def test_links_of_large_and_small_groups_of_three_texts(most):
    rng = np.random.default_rng(3)
    size_a, size_b = np.array([1, 90, 3, 2, 200, 2]), np.array([1, 80, 2, 5, 90, 1])
    a, b = rng.integers(0, 9, size_a.sum()).astype(np.int32), rng.integers(0, 7, size_b.sum()).astype(np.int32)
    cut = np.array([0, 2, 2, 6])
    lot = A.Lot(a, b, np.arange(6), size_a, size_b, np.append(0, np.cumsum(size_a))[cut], np.append(0, np.cumsum(size_b))[cut], cut)
    keys, times, cuts = A.links(lot, most)
    i = j = 0
    want = [Counter(), Counter(), Counter()]
    for g, (n, m) in enumerate(zip(size_a, size_b)):
        want[0 if g < 2 else 2].update((int(x), int(y)) for x in a[i : i + n] for y in b[j : j + m])
        i, j = i + n, j + m
    for t in range(3):
        got = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(keys[cuts[t] : cuts[t + 1]], times[cuts[t] : cuts[t + 1]])}
        assert got == dict(want[t]) and len(got) == cuts[t + 1] - cuts[t]


def test_both_libraries_agree_on_the_byte_level_ids():
    a, _ = A.tokenizers_of(A.FOLDER)
    assert a.ranked is not None
    for t in [t for t in ODD if t] + random_texts(300, 8):
        assert a.ranked.encode_ordinary(" " + t) == a.own.encode(" " + t, add_special_tokens=False).ids, t[:40]


def test_query_of_the_contract(spark, sf_dir):
    from hearthframe.llm.queries import QUERIES

    got = QUERIES["op13_token_alignment"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in COLUMNS[:-1]], ("groups_sha256", "string")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *row) for d, row in zip(docs, plain([d.text for d in docs])))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.filter(F.col("n_groups") > 0).count() > 0

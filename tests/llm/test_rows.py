"""Sharding, mixing, URL filters and lines against plain versions; nulls, ties, repeats, empty tables, clashing names."""

import fnmatch
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import lines, mixing, sharding, urls

DOCS = "doc_id long, text string, source string, shard string, taken string, size string"
ROWS = [
    (1, "one two three", "b", "x", "x", "x"), (2, "", "a", None, None, None), (3, None, "a", "x", "x", "x"), (None, "null id words", None, "x", "x", "x"), (5, "é ü\tñ\n x", "a", "x", "x", "x"),
    (5, "é ü\tñ\n x", "a", "x", "x", "x"), (6, "w " * 5000, "hot", "x", "x", "x"), (7, "a b", "hot", "x", "x", "x"), (8, "c d e", None, "x", "x", "x"), (-9, "neg", "b", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def scalar_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    rng = random.Random(1)
    keys = [rng.getrandbits(63) - (1 << 62) for _ in range(500)] + [0, 1, -1, 2**63 - 1, -(2**63)]
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(np.array(keys, np.int64), n).tolist() == [scalar_jump(k, n) for k in keys]
    a, b = sharding.jump_hash(np.arange(50_000), 24), sharding.jump_hash(np.arange(50_000), 25)
    assert set(b[a != b]) == {24} and 0.03 < (a != b).mean() < 0.05
    with pytest.raises(ValueError):
        sharding.jump_hash(np.array([1]), 0)


def test_shard_report(docs):
    got = sharding.shard_report(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), scalar_jump(i or 0, 24), scalar_jump(i or 0, 25)) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_report(docs.limit(0)).count() == 0
    assert "shard" in sharding.assign_shards(docs).columns and len(sharding.assign_shards(docs).columns) == len(docs.columns)


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        rate = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if rate * w[s] > most * sizes[s]]
        if not over:
            target |= {s: rate * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            open_.discard(s)
    return target


def test_mixing(docs):
    got = mixing.mix(mixing.sized(docs)).collect()
    sizes = defaultdict(int)
    for _, t, s, *_ in ROWS:
        sizes[s] += len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    target = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(mixing.sized(docs.repartition(7))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(mixing.sized(docs.limit(0))).count() == 0


def test_mixing_stage_takes_effect(spark, docs):
    given = docs.select("doc_id", "text", "source", F.length("text").cast("bigint").alias("n_chars"))
    out = mixing.stage(spark, given, "").collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(mixing.sized(docs)).collect():
        want[r.doc_id] += r.taken
    assert words == Counter({k: v for k, v in want.items() if v})


def glob_re(glob):
    host, _, path = glob.partition("/")
    part = lambda s, star: "".join(star if c == "*" else re.escape(c) for c in s)
    return re.compile(part(host, "[^/]*") + ("/" + part(path, ".*") if "/" in glob else ""), re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    globs = ["*.com/*", ".a.b/x*", "*.a*b.c/*z", "*aa*/*b*a", ".x/", "*.long-host-name-that-fills-words.example.com/path/of/some/length/*", "*b/*b*b"]
    texts = ["", ".", "/", ".x/", ".x/y", ".a.b/x", ".q.a1b.c/zzz", ".aa/ba", ".foo.com/", ".foo.net/x.com/", ".é.com/ü"] + ["." + "".join(rng.choice("ab./cxz") for _ in range(rng.randrange(14))) for _ in range(2000)]
    texts.append(".long-host-name-that-fills-words.example.com/path/of/some/length/x" + "y" * 3000)
    got = urls.GlobSet(globs).match(texts)
    for g, glob in enumerate(globs):
        assert got[:, g].tolist() == [bool(glob_re(glob).fullmatch(t)) for t in texts], glob
    assert fnmatch.fnmatchcase(".foo.com/a", "*.com/*")


PAGES = [
    (1, "http://A.Example.COM/en/x?y", "z"), (2, "https://www.example.com/en/", None), (3, "http://b.net/es/1", "q"), (4, "http://b.net", ""), (5, None, ""), (6, "no scheme", ""), (7, "x://", ""), (8, "http://spam-farm.org/a", ""),
    (9, "http://example.com#/en/", ""), (10, "http://notexample.com/en/a", ""), (11, "http://h.org/x://y.com/", ""), (1, "http://A.Example.COM/en/x?y", "z"), (12, "http://com/", ""),
]


def test_url_rules(spark):
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(PAGES, "page_id int, url string, host string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow")
    assert (got[3].rule, got[4].rule, got[4].path) == ("net/es/", None, "")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (5, 6, 7)] == [("", "", None, "block")] * 3
    assert got[8].verdict == "block" and got[8].rule is None
    assert (got[9].host, got[9].path, got[9].rule) == ("example.com", "", None)
    assert got[10].rule == "com/" and got[11].host == "h.org" and got[12].rule == "com/"
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_lines(spark):
    rng = random.Random(2)
    common = ["License line", " shared footer \t", "near nine", "near ten"]
    rows = []
    for i in range(60):
        source = f"s{i % 13}" if i % 17 else None
        text = "\n".join([common[0], f"own {i}", "", common[1] if i % 2 else "x", common[2] if i % 13 < 9 else "", common[3] if i % 13 < 10 else "", "dup", "dup" if i % 3 else ""])
        rows.append((i if i % 11 else None, source, text, rng.random()))
    rows += [(100, "s1", None, 0.0), (101, "s2", "", 0.0), (0, "s0", rows[0][2], 0.0), (103, "s3", "long line " * 20_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, gone double")
    sites = defaultdict(set)
    for _, s, t, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r"):
                sites[x.strip(" \t\r")].add(s)
    bad = {x for x, s in sites.items() if len(s) >= 10}
    assert bad and "near nine" not in bad or len(sites["near nine"]) >= 10
    want = Counter()
    for d, _, t, _ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if x.strip(" \t\r") not in bad]
        want[(d, "\n".join(kept), sum(1 for x in every if x.strip(" \t\r")), len(every) - len(kept))] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.clean(df.select("doc_id", "source", "text")).collect())
    assert got == want
    assert lines.clean(df.limit(0).select("doc_id", "source", "text")).count() == 0
    assert hashlib.md5(b"").hexdigest()


def test_patterns_from_a_table(spark):
    rows = [("block", "Bad.example", "/", None), ("allow", "bad.example", "/ok/", None), (None, None, None, "*/*.tar"), (None, None, None, None), ("block", None, "/", None)]
    rules, globs = urls.read_rules(spark.createDataFrame(rows, "verdict string, host string, path string, glob string"))
    assert rules == (("block", "bad.example", "/"), ("allow", "bad.example", "/ok/")) and globs == ("*/*.tar",)
    pages = [(1, "http://x.BAD.example/a"), (2, "http://bad.example/ok/b.tar"), (3, "http://good/b.tar"), (4, "http://good/" + "b" * 200_000), (5, None), (6, "http://notbad.example/"), (1, "http://x.BAD.example/a")]
    df = spark.createDataFrame(pages, "page_id int, url string").withColumn("verdict", F.lit("clash"))
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, rules, globs).collect())
    assert got == [(1, "bad.example/", "block")] * 2 + [(2, "bad.example/ok/", "allow"), (3, None, "block"), (4, None, "allow"), (5, None, "block"), (6, None, "allow")]
    assert {r.verdict for r in urls.judge(df.filter("url IS NOT NULL"), (), ()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.read_rules(spark.createDataFrame(rows, "verdict string, host string, path string, glob string"), most=4)


def test_many_patterns_at_once():
    rng = random.Random(1)
    globs = [f"*.{''.join(rng.choices('abc', k=3))}/*{''.join(rng.choices('xyz', k=4))}*" for _ in range(400)]
    texts = [f".{''.join(rng.choices('abc.', k=9))}/{''.join(rng.choices('xyz/', k=30))}" for _ in range(300)]
    got = urls.GlobSet(globs).match(texts)
    assert got.sum() > 50
    for g, glob in enumerate(globs):
        pattern = re.compile(urls.glob_regex(glob), re.S)
        assert got[:, g].tolist() == [bool(pattern.fullmatch(t)) for t in texts]


def test_clashing_columns_pass_the_stages(spark):
    rows = [(1, "a b c", "s", 3, "x"), (None, None, None, None, "y"), (2, "", "t", 0, "z"), (2, "", "t", 0, "z")]
    names = ["size", "target", "taken", "source_size", "score", "shard", "slot", "__key", "__words", "weight"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string").withColumns({n: F.lit(n) for n in names})
    mixed = mixing.stage(spark, docs, "")
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.collect()} == {"size"}
    placed = sharding.stage(spark, docs, "")
    assert len(placed.columns) == len(docs.columns) and placed.count() == 4

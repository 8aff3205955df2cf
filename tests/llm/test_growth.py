"""Work and memory that must not grow faster than the input: long texts of boilerplate, patterns by the thousand."""

import time
import tracemalloc

from pyspark.sql import functions as F

from hearthframe.llm import lines, urls


def test_rules_are_prefixes_to_the_letter(spark):
    rules = (("block", "example.com", "/*x"), ("allow", "example.com", "/en/"), ("block", "example.com", "/en/*"))
    df = spark.createDataFrame([(1, "http://example.com/en/x"), (2, "http://a.example.com/*xy"), (3, "http://example.com/en/*1"), (4, "http://example.com/q"), (5, "http://badexample.com/*x")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules, ()).collect()}
    assert got == {1: ("example.com/en/", "allow"), 2: ("example.com/*x", "block"), 3: ("example.com/en/*", "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_packs_of_patterns_judge_alike(spark, monkeypatch):
    rules = tuple((("allow", "block")[i % 2], f"h{i % 7}.com", f"/{'p' * (i % 5)}{i % 3}") for i in range(60))
    globs = tuple(f"*/{i}*" for i in range(40)) + ("*h3*/*z",)
    df = spark.createDataFrame([(i, f"http://{'a.' * (i % 2)}h{i % 9}.com/{'p' * (i % 6)}{i % 4}{'z' * (i % 2)}") for i in range(400)] + [(900, None)], "page_id int, url string").coalesce(1)
    seen = []
    for pack, at_once in ((1, 7), (13, 50), (256, 4096)):
        monkeypatch.setattr(urls, "PACK", pack)
        monkeypatch.setattr(urls, "ROWS_AT_ONCE", at_once)
        seen.append(sorted(map(str, urls.judge(df, rules, globs).collect())))
    assert seen[0] == seen[1] == seen[2]


def test_memory_of_a_pack_holds_for_any_number_of_patterns():
    """2,000 patterns over 4,096 urls: a pack at a time stays far below what all states at once would take."""
    texts = [f"h{i}.example.com/p{i % 50}/" for i in range(2000)]
    packs = [urls.GlobSet([], texts[i : i + urls.PACK]) for i in range(0, len(texts), urls.PACK)]
    asked = [f".h{i % 3000}.example.com/p{i % 50}/q" for i in range(4096)]
    tracemalloc.start()
    hits = sum(int(p.match(asked).sum()) for p in packs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits == sum(1 for i in range(4096) if i % 3000 < 2000 and i % 3000 % 50 == i % 50) and peak < 150 * 2**20


def test_long_texts_of_boilerplate_take_time_by_their_lines(spark):
    def took(n):
        body = "\n".join(["", " mine "] + [f"line {i}" if i % 3 else "" for i in range(n)])
        df = spark.createDataFrame([(k, f"s{k}", body + f"\nown {k}") for k in range(12)], "doc_id bigint, source string, text string").repartition(4)
        began = time.perf_counter()
        rows = lines.clean(df).select("doc_id", "n_lines", "n_removed", "text").collect()
        spent = time.perf_counter() - began
        shared = sum(1 for i in range(n) if i % 3) + 1
        assert all(r.n_lines == shared + 1 and r.n_removed == shared and r.text.replace("\n", "") == f"own {r.doc_id}" for r in rows)
        assert all(r.text.count("\n") == n + 2 - shared for r in rows)
        return spent

    took(200)
    small, large = took(8000), took(16000)
    assert large < 3 * small + 2, (small, large)


def test_places_that_go_are_cut_out(spark):
    rows = [(["a", "b", "c", "d"], g) for g in ([0], [3], [0, 3], [1, 2], [0, 1, 2, 3], [2])]
    got = spark.createDataFrame(rows, "e array<string>, g array<int>").select(lines.without(F.col("e"), F.col("g")).alias("k")).collect()
    assert [r.k for r in got] == [[x for i, x in enumerate(e) if i not in g] for e, g in rows]

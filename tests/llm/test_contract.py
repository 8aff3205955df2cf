"""Every opN query as it is registered: columns, types, held-out rows, cuts and digests of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hearthframe.llm.queries import QUERIES

LONG, INT, TEXT, REAL, FLAG = "bigint", "int", "string", "double", "boolean"
COLUMNS = {
    "op1_bootstrapped_pii": dict(doc_id=LONG, n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, base_sha256=TEXT, spans=TEXT),
    "op2_jump_hash_sharding": dict(doc_id=LONG, size=LONG, text_crc32=LONG, law=TEXT, shard=INT, slot=LONG, grown_shard=INT),
    "op3_compression_quality": dict(doc_id=LONG, held_out=FLAG, score=REAL, predicted=INT),
    "op4_fm_toxicity": dict(doc_id=LONG, held_out=FLAG, score=REAL, predicted=INT),
    "op5_mix_sources": dict(doc_id=LONG, size=LONG, source_size=LONG, target=REAL, taken=LONG),
    "op7_hilbert_neighbours": dict(query_id=LONG, rank=INT, vec_id=LONG, score=REAL),
    "op9_benchmark_decontamination": dict(doc_id=LONG, n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=TEXT, contaminated=FLAG),
    "op10_glob_url_filter": dict(page_id=LONG, host=TEXT, path=TEXT, rule=TEXT, verdict=TEXT),
    "op11_centroid_language": dict(doc_id=LONG, held_out=FLAG, lang_pred=TEXT, score=REAL),
    "op12_importance_resampling": dict(doc_id=LONG, n_features=LONG, weight=LONG, score=LONG, rank=LONG),
    "op13_token_alignment": dict(doc_id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, n_best=LONG, count_sum=LONG, groups_sha256=TEXT),
}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, sf_dir)
            held[name] = (df.dtypes, [r.asDict() for r in df.collect()])
        return held[name]

    return of


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(run, docs, name):
    kinds, rows = run(name)
    assert {k: v for k, v in kinds if k in COLUMNS[name]} == COLUMNS[name]
    if "doc_id" in COLUMNS[name]:
        assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))


@pytest.mark.parametrize("name, folds, held", [("op3_compression_quality", 5, 0), ("op4_fm_toxicity", 4, 2), ("op11_centroid_language", 4, 2)])
def test_held_out_rows_and_cuts(run, name, folds, held):
    for r in run(name)[1]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1
        assert "predicted" not in r or r["predicted"] == int(r["score"] >= 0.3)


def test_digests_of_personal_data(run, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k == "email" or (all(int(p) <= 255 for p in m.split(".")) if k == "ip" else 9 <= len(d) <= 15)

    for r in run("op1_bootstrapped_pii")[1]:
        base = [f"{k}:{m.start()}:{m.end()}" for k, rx in kinds.items() for m in re.finditer(rx, docs[r["doc_id"]]["text"] or "") if good(k, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(","))
        n = Counter(b.split(":")[0] for b in base)
        assert all(r[f"n_{k}"] == n[k] for k in kinds)


def test_shards_keep_the_law_of_the_key(run, docs):
    shards = defaultdict(list)
    for r in run("op2_jump_hash_sharding")[1]:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key" and 0 <= r["shard"] < 24
        assert r["grown_shard"] in (r["shard"], 24)
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_mixture_takes_near_its_targets(run):
    rows = run("op5_mix_sources")[1]
    sources = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
        sources[r["source_size"], r["target"]].append(r["taken"])
    assert all(abs(sum(t) - target) <= max(1.0, 0.01 * target) for (_, target), t in sources.items())


def test_decontamination_digests(run, spark, sf_dir, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: tuple(word.findall((t or "").translate({c: c + 32 for c in range(65, 91)})))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[w[i : i + 13]].add(str(r["item_id"]))
    sizes = {len(w) for w in windows}
    for r in run("op9_benchmark_decontamination")[1]:
        w, hit, items = words(docs[r["doc_id"]]["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in windows:
                    hit.update(range(i, i + n))
                    items |= windows[w[i : i + n]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() and r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_neighbours_are_ranked(run, spark, sf_dir):
    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    found = defaultdict(list)
    for r in run("op7_hilbert_neighbours")[1]:
        found[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, min(20, len(ids) - 1) + 1)) and q not in {r[2] for r in rows}
        assert [(-s, v) for _, s, v in rows] == sorted((-s, v) for _, s, v in rows)


def test_lines_and_links_are_whole(run, docs):
    rows = run("op6_line_spread_dedup")[1]
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs)) and all(0 <= r["n_removed"] <= r["n_lines"] for r in rows)
    links = run("op8_chosen_path_jaccard")[1]
    assert Counter(r["doc_id"] for r in links) == Counter(list(docs))
    by_text = Counter(d["text"] or "" for d in docs.values())
    assert all(r["n_copies"] == by_text[docs[r["doc_id"]]["text"] or ""] and r["class_id"] <= r["doc_id"] for r in links)

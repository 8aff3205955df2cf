"""PII, quality, toxicity and decontamination against plain versions and held-out rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthframe.llm import contamination, pii, quality, toxicity

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and luhn % 10 == 0
    return True


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, rx in BASE.items() for m in re.finditer(rx, text or "") if valid(k, m.group())]


def luhn_card(rng, n=16):
    d = [rng.randrange(10) for _ in range(n - 1)]
    s = sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(reversed([*d, 0])))
    return "".join(map(str, [*d, -s % 10]))


def test_base_spans_against_re(spark):
    rng = random.Random(7)
    texts = [None, "", "a@b", "a@b.c%x@d.e", "é" * 5 + " x.y@z.co.uk. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "+1 (017) 555-7713 and 4539 1488-0343 6467", luhn_card(rng) + "-" + luhn_card(rng), "😀 a@b.cd 😀 10.0.0.1"]
    texts += ["".join(rng.choice("ab.@-+ 0159()%é\n") for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["".join(rng.choice("a.@0") for _ in range(60)) for _ in range(200)] + ["x" * 60_000, "1" * 60_000, "1.2.3.4 " * 4000, "a@b.c " * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    for i, t in enumerate(texts):
        spans = [(pii.KINDS[b.kind], b.s, b.e) for b in got[i].base]
        assert spans == plain_spans(t), (i, t[:80])
    assert pii.find(rows.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(3)
    seeds = [f"text {i} customer card {luhn_card(rng)} ends here" for i in range(40)]
    unseen = ["a customer card 4111111111111112 ends here", "a customer card soon ends here", "some number 4111111111111112 elsewhere"]
    rows = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id int, text string")
    got = {r.doc_id: [(pii.KINDS[x.kind], x.s, x.e) for x in r.extra] for r in pii.find(rows).collect()}
    assert got[40] == [("card", 16, 32)]
    assert not any(v for k, v in got.items() if k != 40 and k != 42)


def found_spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("base", F.lit("clash")).repartition(3)
    return {r.doc_id: [(pii.KINDS[x.kind], x.s, x.e) for x in r.extra] for r in pii.find(rows).collect()}


@pytest.mark.parametrize(
    ("seed", "unseen", "kind"),
    [
        ("call mobile +1 (415) 555-1{:03d} today", "call mobile 415-555-2{:03d} today", "phone"),
        ("my account mail joe{}@mail.example now", "my account mail jill{}@localhost now", "email"),
        ("Server=10.0.7.{} is down", "server=10-1-7-{} was up", "ip"),
        ("reach tel:+256 772 001 {:03d} (home)", "reach tel:0772.002.{:03d} (work)", "phone"),
    ],
)
def test_whole_spans_teach_contexts(spark, seed, unseen, kind):
    texts = [seed.format(i + 100) for i in range(40)] + [unseen.format(i + 100) for i in range(20)] + [None, "", "mobile mail tel:", "\ue001 +1 (415) 555-1999 \ue0b0"]
    got = found_spans(spark, texts)
    for i in range(40, 60):
        (found,) = got[i]
        assert found[0] == kind and re.fullmatch(r"[0-9a-z@.-]+", texts[i][found[1] : found[2]]), (texts[i], found)
    assert not any(v for i, v in got.items() if not 40 <= i < 60)


def plain_bootstrap(edges, rounds=pii.ROUNDS):
    """(core, kind) by the scores of the docstring, in plain Python."""
    shape = lambda k, c: re.search(pii.SHAPES[pii.KINDS[k]], c) is not None
    of = {}
    for p, c, k in edges:
        of.setdefault(p, set()).add(c)
    known = [(p, c, k, 1.0) for p, c, k in edges if k >= 0]
    unseen = {(p, c) for p, c, k in edges if k < 0}
    for _ in range(rounds):
        mass, support = {}, {}
        for p, _, k, s in known:
            mass[p, k] = mass.get((p, k), 0.0) + s
            support[p, k] = support.get((p, k), 0) + (s >= 0.5)
        good = {pk: m / (len(of[pk[0]]) + 1) for pk, m in mass.items() if support[pk] >= pii.LEAST_SUPPORT and m / (len(of[pk[0]]) + 1) >= pii.LEAST_PATTERN}
        doubt = {}
        for p, c in unseen:
            for k in range(4):
                if (p, k) in good and shape(k, c):
                    doubt[c, k] = doubt.get((c, k), 0.0) + math.log1p(-min(good[p, k], 0.999))
        best = {}
        for (c, k), d in sorted(doubt.items(), key=lambda x: x[0][1]):
            if 1 - math.exp(d) > best.get(c, (None, 0.0))[1]:
                best[c] = (k, 1 - math.exp(d))
        found = {c: v for c, v in best.items() if v[1] >= 0.5}
        known = [(p, c, k, 1.0) for p, c, k in edges if k >= 0] + [(p, c, *found[c]) for p, c in unseen if c in found]
    return {(c, k) for c, (k, s) in found.items() if s >= pii.LEAST_INSTANCE}


def test_scores_against_plain(spark):
    from hearthframe.llm.common import Scratch

    rng = random.Random(13)
    edges = set()
    for i in range(900):
        kind = rng.choice([-1, 0, 0, 1, 1, 2, 2, 3, 3])
        core = {0: f"a{i}@b.c", 1: f"1.2.3.{i % 250}", 2: luhn_card(rng), 3: f"+1 415 555 {i:04d}"}.get(kind) or rng.choice([f"u{i % 60}@h", f"10-0-0-{i % 90}", f"07{i % 80:08d}", f"word{i}"])
        for _ in range(rng.randrange(1, 4)):
            edges.add((f"l:w{(rng.randrange(4) if kind < 0 else kind) * 5 + rng.randrange(6)}", core, kind))
    got = pii.bootstrap(spark.createDataFrame(sorted(edges), "pattern string, core string, kind int"), Scratch(spark, "t")).collect()
    want = plain_bootstrap(edges)
    assert {(r.core, r.found) for r in got} == want and len(want) > 3


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in pii.redact(rows).collect()} == {1: "mail xxxxxx now", 2: ""}


def corpus(spark, n=400):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randrange(20, 120))
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            w[3:3] = rng.sample(["idiot", "moron", "scum"], 2)
        if not good:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(good), int(toxic), "clash"))
    docs += [(n, "", "en"), (n + 1, None, "en"), (0, docs[0][1], "en"), (n + 2, "word " * 30_000, None)]
    labels += [(None, 1, 0, "x"), (5, None, None, "x"), (0, labels[0][1], labels[0][2], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def held_out_auc(scores, labels, label):
    pairs = [(scores[r.doc_id], r[label]) for r in labels.collect() if r.doc_id is not None and r[label] is not None]
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in labels.select("doc_id", "toxic").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert held_out_auc(scores, spark.createDataFrame(held, "doc_id long, toxic int"), "toxic") > 0.95
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert len({r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()}) == 1


def test_factorization_learns_a_pair():
    rng = np.random.default_rng(1)
    terms, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        terms.append(np.array(sorted({100 + int(x) for x in rng.integers(0, 40, 8)} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a and b))
    fm = toxicity.fit(terms, np.array(y), bits=10, epochs=30)
    both, one = fm.score(np.array([1, 2])), fm.score(np.array([1]))
    assert both > 0.5 > one


def test_quality(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in labels.select("doc_id", "quality").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held_out_auc({r["doc_id"]: r["score"] for r in rows}, spark.createDataFrame(held, "doc_id long, quality int"), "quality") > 0.95
    plain = quality.train(docs, labels.limit(0))
    assert quality.score(docs.limit(3), plain, ["doc_id"]).count() == 3


def test_quality_is_the_difference_of_direct_compressions(spark):
    import zstandard

    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    texts = [None, "", "a", "word " * 9_000, "é" * 700, *[r["text"] for r in docs.limit(30).collect()]]

    def size(text, content):
        raw = text.encode()
        with_dict = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(with_dict.compress(raw[i : i + 256])) for i in range(0, len(raw), 256))

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("difference", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in quality.score(rows.select("doc_id", "text"), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        a, b = (size(t, model.bad), size(t, model.good)) if t else (1, 1)
        d = 10 * (a - b) / (a + b)
        z = model.weights @ np.array([1, d, d * abs(d)])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert quality.score(rows.limit(0), model, ["doc_id"]).count() == 0
    assert quality.train(docs, labels, lot=40).weights[1] != 0
    odd = labels.union(spark.createDataFrame([(10_000 + i, 7) for i in range(50)], labels.schema)) if len(labels.columns) == 2 else labels
    assert quality.train(docs, odd).good == quality.train(docs, labels).good


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    fm = toxicity.FactorizationMachine(0.3, rng.normal(size=64), rng.normal(size=(64, 4)), 1.5, -0.2)
    texts = [np.unique(rng.integers(0, 64, n)) for n in (0, 1, 2, 7, 0, 40, 3)]
    want = [0.3 + sum(fm.linear[i] for i in t) + sum(fm.factors[i] @ fm.factors[j] for a, i in enumerate(t) for j in t[a + 1 :]) for t in texts]
    assert np.allclose(fm.margins(texts), want)
    assert np.allclose(fm.scores(texts), [1 / (1 + math.exp(-1.5 * w + 0.2)) for w in want])


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain_near(w, windows, slack):
    """Words from the first to the last word of any proximity match, by walking all chains."""
    near = set()
    for k in windows:
        chains = {(i, i) for i, x in enumerate(w) if x == k[0]}
        for word in k[1:]:
            chains = {(s, q) for s, p in chains for q in range(p + 1, min(len(w), p + slack + 2)) if w[q] == word}
        for s, p in chains:
            near |= set(range(s, p + 1))
    return near


def plain_contamination(docs, items, window, slack):
    found = {}
    for i, t in items:
        w = plain_words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - window + 1)):
            found.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = plain_words(t)
        hit, ids = set(), set()
        for n in {len(k) for k in found}:
            for j in range(len(w) - n + 1):
                if (x := found.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    ids |= x
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w), len(plain_near(w, found, slack))))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("block", "segment"), [(100_000, 1_000_000), (3, 50)])
def test_decontamination_against_plain(spark, block, segment):
    rng = random.Random(9)
    v = ["a", "b", "c", "É", "naïve", "x1"]
    items = [(str(i), " ".join(rng.choices(v, k=rng.choice([0, 1, 2, 4, 5, 6])))) for i in range(10)] + [(None, "a b c"), ("11", None), ("10", "b, A"), ("10", "b a c"), ("", "c c É x1"), ("a\x1fb", "x1 naïve x1 b"), (" ", "b b b a")]
    docs = [(i if i % 7 else None, " ".join(rng.choices([*v, "--", "B", "other"], k=rng.randrange(0, 40)))) for i in range(80)] + [(99, None), (100, ""), (1, "a b"), (1, "a b"), (101, "a " * 3_000), (102, "c c É x1"), (103, "x1 naïve z x1 z z b")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)
    got = contamination.decontaminate(rows, spark.createDataFrame(items, "item_id string, text string"), window=4, slack=2, block_windows=block, segment_words=segment)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_contamination(docs, items, 4, 2)


def test_decontamination_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in contamination.decontaminate(d, b).collect()] == [(1, 1, 0)]
    assert contamination.decontaminate(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "the quick brown red fox jumps"), (2, "quick a b c d brown fox"), (3, "fox brown quick"), (4, "quick"), (5, "brown fox"), (6, "a quick brown fox")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    got = {r.doc_id: (r.n_near, r.n_hit, r.n_items) for r in contamination.decontaminate(d.coalesce(1), b, slack=2).collect()}
    assert got == {1: (4, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (3, 3, 1)}
    assert {r.n_near for r in contamination.decontaminate(d.filter("doc_id = 1"), b, slack=0).collect()} == {0}
    with pytest.raises(ValueError):
        contamination.decontaminate(d, b, slack=64)


@pytest.mark.parametrize("law", ["apart", "beside"])
def test_terms_that_tell_only_in_a_pair(law):
    rng = np.random.default_rng(11)
    terms, y = [], []
    for i in range(2000):
        a, b = rng.integers(0, 2, 2)
        toxic = a != b if law == "apart" else (rng.random() < (0.95 if b else 0.55)) if a else (rng.random() < (0.05 if b else 0.45))
        terms.append(np.array(sorted({100 + int(x) for x in rng.integers(0, 40, 8)} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(toxic))
    telling = toxicity.telling_terms(terms, np.array(y), 1024)
    assert not telling[2] and telling[1] == (law == "beside")
    assert set(np.flatnonzero(toxicity.telling_pairs(terms, np.array(y), 1024, telling))) == {1, 2}
    fm = toxicity.fit(terms, np.array(y), bits=10, epochs=30)
    none, one, two, both = (fm.score(np.array(x, np.int64)) for x in ([], [1], [2], [1, 2]))
    assert one > both and two > both and both < 0.2 < 0.8 < one if law == "apart" else both > one + 0.1 and two < none - 0.1


def test_toxicity_is_fitted_in_tasks(spark, monkeypatch):
    """The driver runs no fit of its own; the tasks' machine is that of a plain fit of the same rows."""
    docs, labels = corpus(spark)
    hasher = toxicity.TermHasher()
    rows = toxicity.teaching_rows(docs.select("doc_id", "text"), toxicity.with_held_out(labels, "toxic", 4, 2), toxicity.MOST_ROWS).collect()
    rows = sorted((r["doc_id"], r["label"], hasher(r["text"]).astype(np.int32).tobytes()) for r in rows)
    taught = [r["label"] for r in toxicity.with_held_out(labels, "toxic", 4, 2).collect()]
    plain = toxicity.fit([np.frombuffer(t, np.int32).astype(np.int64) for _, _, t in rows], np.array([y for _, y, _ in rows], float), prior=sum(taught) / len(taught)).thin()

    def refused(*_):
        raise AssertionError("pairs are sought on the driver")

    monkeypatch.setattr(toxicity, "telling_pairs", refused)
    made = toxicity.train(docs, labels)
    assert (made.bias, made.slope, made.shift) == (plain.bias, plain.slope, plain.shift)
    assert (made.linear == plain.linear).all() and (made.factors == plain.factors).all()

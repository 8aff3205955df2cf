"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from fixed patterns (email, ip, card, phone) and their checks. They are the seeds: an identifier is a
whole span, blanks and all, and its lexical patterns are the words before and after it. Patterns and the identifiers
they occur with form a graph that Spark scores in rounds: a pattern is as good for a kind as the identifiers it occurs
with, an identifier as sure as its good patterns make it. Tokens of a fitting shape that good patterns vouch for become
further spans of that kind. Base spans stay.

To find contexts outside the spans, every character of a base span is put under a shield: a character of the private
use area that stands for it and for the span's kind. A span is then one token, its kind can be read off it, and offsets
stay the same. Where base spans of two kinds overlap, one of them is the seed; both are returned.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Texts of any length are scanned whole,
tokens and contexts of any length too, in time that grows with the text's length: patterns are possessive and start at
the edge of a run, and a context is sought only between two tokens. Repeated rows are rows of their own, but an
identifier supports a pattern once, however often it is copied. Of kinds with equal scores an identifier gets the first.
Null ids stay null. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table, text_or_empty

#: Fixed values of the contract, in its order; possessive forms of the same languages, anchored at the start of a run
#: (or at the end of the last match), where the leftmost match starts in any case.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = "[0-9](?:[\\x20-]?[0-9])++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

#: Characters a base span can hold, and the private-use characters that stand for them, kind by kind.
SPAN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@ ()"
SHIELDS = tuple("".join(chr(0xE000 + 128 * k + ord(c)) for c in SPAN_CHARACTERS) for k in range(len(KINDS)))
SHIELDED = "\uE000-\uE1FF"
SHIELDED_RUN = "|".join(f"[{chr(0xE000 + 128 * k)}-{chr(0xE07F + 128 * k)}]++" for k in range(len(KINDS)))
#: Kinds in the order in which they shield their spans: phone numbers before the digits in them.
SHIELD_ORDER = ("phone", "card", "ip", "email")

#: A token that may be an identifier: it holds a digit, an @ or a shield.
TOKEN = f"(?<!\\S)[^\\s0-9@{SHIELDED}]*+[0-9@{SHIELDED}]\\S*+"
LAST_WORD = "(?<!\\S)(\\S++)\\s*+$"
LAST_TWO = "(?<!\\S)(\\S++\\s++\\S++)\\s*+$"
FIRST_WORD = "^\\s*+(\\S++)"
#: What may stand before an identifier in its token: a label up to a colon or equals sign, and punctuation.
LABEL = f"^(?:[^\\s0-9@{SHIELDED}:=]*+[:=])?[\\p{{Punct}}&&[^+(]]*+"
ROUNDS = 3
LEAST_SUPPORT = 5
LEAST_PATTERN = 0.6
LEAST_INSTANCE = 0.9
#: Shapes an unseen identifier of each kind may have.
SHAPES = {
    "email": "^[^@\\s]++@[^@\\s]++$",
    "ip": "^[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}$",
    "card": "^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9]+(?:[-.][0-9]+)*$",
    "phone": "^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+(]?[0-9]+(?:[().-]+[0-9]+)*$",
}


def _running(lengths: Column) -> Column:
    """Exclusive running sums of an array of ints."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("p")),
        lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["p"], acc["t"]).alias("p")),
        lambda acc: acc["p"],
    )


def prefix_sums(lengths: Column, chunk: int = 256) -> Column:
    """Exclusive running sums, chunk by chunk, so that an array of n costs n * chunk at most rather than n * n."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / chunk).cast("int")), lambda b: F.slice(lengths, (b * chunk + 1).cast("int"), chunk))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(F.transform(chunks, _running), _running(totals), lambda c, o: F.transform(c, lambda x: x + o)))


def located(text: Column, pattern: str) -> tuple[Column, Column]:
    """Non-overlapping leftmost matches as text, and the pieces between them; one more piece than matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def with_matches(df: DataFrame, text: str, pattern: str, gate: Column, name: str) -> DataFrame:
    """Adds ``name``: array of (s, e, m); texts that fail the cheap gate are not searched."""
    found, between = located(F.col(text), pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(gate, found).otherwise(none))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.transform(between, lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("__n", F.transform("__m", lambda x: F.length(x)))
    df = df.withColumn("__b", F.when(F.size("__m") > 0, prefix_sums(F.zip_with(F.slice("__g", 1, F.size("__n")), F.col("__n"), lambda g, n: g + n))).otherwise(F.array().cast("array<int>")))
    starts = F.zip_with(F.col("__b"), F.slice("__g", 1, F.size("__n")), lambda b, g: b + g)
    spans = F.zip_with(starts, F.col("__m"), lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))
    return df.withColumn(name, F.when(F.size("__m") > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))).drop("__m", "__g", "__n", "__b")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def gate(kind: str, text: Column) -> Column:
    """A cheap test that a text with a span of the kind passes."""
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    return text.rlike("[0-9]\\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base``: array of (kind, s, e, m), by kind and start."""
    df = docs
    for kind in KINDS:
        df = with_matches(df, text, PATTERNS[kind], gate(kind, F.col(text)), f"__{kind}")
    def checked(i: int, kind: str) -> Column:
        valid = F.filter(f"__{kind}", lambda x: _valid(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

    parts = [checked(i, kind) for i, kind in enumerate(KINDS)]
    return df.withColumn("base", F.concat(*parts)).drop(*[f"__{k}" for k in KINDS])


def replaced(df: DataFrame, text: str, kind: str, by: Callable[[Column], Column]) -> DataFrame:
    """The text with every valid span of the kind replaced, rebuilt from the pieces between matches in one pass."""
    found, between = located(F.col(text), PATTERNS[kind])
    df = df.withColumn("__m", F.when(gate(kind, F.col(text)), found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, between))
    made = F.zip_with(F.slice("__g", 1, F.size("__m")), F.col("__m"), lambda g, m: F.concat(g, F.when(_valid(kind, m), by(m)).otherwise(m)))
    return df.withColumn(text, F.when(F.size("__m") > 0, F.concat(F.array_join(made, ""), F.element_at("__g", -1))).otherwise(F.col(text))).drop("__m", "__g")


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cands``: array of (s, e, core, patterns, kind), kind that of a base span or -1 for a token that may be an identifier."""
    own = F.when(F.col(text).rlike(f"[{SHIELDED}]"), F.regexp_replace(text, f"[{SHIELDED}]", "\uFFFD")).otherwise(F.col(text))
    df = df.withColumn("__x", own)
    for kind in SHIELD_ORDER:
        df = replaced(df, "__x", kind, lambda m, k=KINDS.index(kind): F.translate(m, SPAN_CHARACTERS, SHIELDS[k]))
    found, between = located(F.col("__x"), TOKEN)
    none = F.array().cast("array<string>")
    df = df.withColumn("__t", F.when(F.col("__x").rlike(f"[0-9@{SHIELDED}]"), found).otherwise(none))
    df = df.withColumn("__p", F.when(F.size("__t") > 0, between).otherwise(none))
    df = df.withColumn("__b", F.when(F.size("__t") > 0, prefix_sums(F.zip_with(F.slice("__p", 1, F.size("__t")), F.col("__t"), lambda g, t: F.length(g) + F.length(t)))).otherwise(F.array().cast("array<int>")))

    # Each token with its place and the gaps around it; a lambda that read other columns might have them made anew for each element.
    around = F.zip_with(F.slice("__p", 1, F.size("__t")), F.slice("__p", 2, F.size("__t")), lambda g, a: F.struct(g.alias("gap"), a.alias("after")))
    placed = F.zip_with(F.zip_with("__t", "__b", lambda t, b: F.struct(t.alias("token"), b.alias("b"))), around, lambda x, y: F.struct(x["token"].alias("token"), x["b"].alias("b"), y["gap"].alias("gap"), y["after"].alias("after")))

    def one(t: Column) -> Column:
        """Where the identifier starts in its token, the identifier (shielded if it is a seed), the gaps around the token."""
        token = t["token"]
        span = F.regexp_extract(token, SHIELDED_RUN, 0)
        before = F.when(span != "", F.regexp_extract(token, f"^[^{SHIELDED}]*+", 0)).otherwise(F.regexp_extract(token, LABEL, 0))
        rest = F.regexp_replace(F.substring(token, F.length(before) + 1, F.length(token)), "(?<!\\p{Punct})\\p{Punct}++$", "")
        core = F.when(span != "", span).otherwise(rest)
        return F.struct((t["b"] + F.length(t["gap"]) + F.length(before)).alias("s"), core.alias("core"), (span != "").alias("seed"), F.lower(before).alias("before"), F.lower(t["gap"]).alias("gap"), F.lower(t["after"]).alias("after"))

    def described(c: Column) -> Column:
        word, labelled = F.regexp_extract(c["gap"], LAST_WORD, 1), c["before"].rlike("[^\\p{Punct}]")
        left = F.when(labelled, c["before"]).otherwise(word)
        two = F.when(labelled, F.when(word != "", F.concat(word, F.lit(" "), c["before"])).otherwise("")).otherwise(F.regexp_extract(c["gap"], LAST_TWO, 1))
        patterns = F.array(F.concat(F.lit("l:"), left), F.concat(F.lit("ll:"), two), F.concat(F.lit("r:"), F.regexp_extract(c["after"], FIRST_WORD, 1)))
        kind = F.when(c["seed"], F.floor((F.ascii(c["core"]) - 0xE000) / 128)).otherwise(-1).cast("int")
        core = F.when(c["seed"], F.translate(c["core"], "".join(SHIELDS), SPAN_CHARACTERS * len(SHIELDS))).otherwise(c["core"])
        return F.struct(c["s"].alias("s"), (c["s"] + F.length(core)).alias("e"), core.alias("core"), F.filter(patterns, lambda p: ~p.isin("l:", "ll:", "r:")).alias("patterns"), kind.alias("kind"))

    df = df.withColumn("__c", F.when(F.size("__t") > 0, F.transform(placed, one)))
    kept = F.transform(F.filter("__c", lambda c: c["core"] != ""), described)
    none = F.array().cast("array<struct<s:int,e:int,core:string,patterns:array<string>,kind:int>>")
    return df.withColumn("cands", F.coalesce(kept, none)).drop("__x", "__t", "__p", "__b", "__c")


def fits(kind: Column, core: Column) -> Column:
    return reduce(lambda a, b: a | b, [(kind == i) & core.rlike(SHAPES[k]) for i, k in enumerate(KINDS)])


def bootstrap(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(core, kind) of identifiers that good patterns vouch for.

    edges: distinct (pattern, core, kind), kind -1 where unknown. Each round joins and aggregates the edges by
    pattern and by identifier; counts are combined before the shuffle, so a common pattern is no hot task.
    """
    sizes = edges.groupBy("pattern").agg(F.count_distinct("core").alias("n"))
    known = edges.filter("kind >= 0").select("pattern", "core", "kind").withColumn("score", F.lit(1.0))
    found = None
    for r in range(rounds):
        support = known.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= 0.5).alias("support"))
        good = support.join(sizes, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + 1)).filter((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_PATTERN))
        good = scratch.write(good.select("pattern", "kind", "confidence"), f"patterns{r}")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        unseen = edges.filter("kind = -1").select("pattern", "core")
        scored = unseen.join(good, "pattern").filter(fits(F.col("kind"), F.col("core"))).groupBy("core", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = scored.groupBy("core").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b")).select("core", "b.kind", "b.score")
        found = scratch.write(best.filter(F.col("score") >= 0.5), f"instances{r}")
        grown = unseen.join(found, "core").select("pattern", "core", "kind", "score")
        known = edges.filter("kind >= 0").select("pattern", "core", "kind", F.lit(1.0).alias("score")).unionByName(grown)
    return found.filter(F.col("score") >= LEAST_INSTANCE).select("core", F.col("kind").alias("found"))


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, extra) per row of (doc_id, text): arrays of (kind, s, e), extra by kind and start."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    scanned = with_candidates(base_spans(rows)).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"))).alias("base"), "cands"
    )
    scanned = scratch.write(scanned, "scanned")  # spans and contexts, no texts; from here on the row ids are fixed
    cands = scanned.select("uid", F.explode("cands").alias("c"))
    edges = cands.select(F.explode("c.patterns").alias("pattern"), F.lower("c.core").alias("core"), F.col("c.kind").alias("kind")).distinct()
    found = bootstrap(scratch.write(edges, "edges"), scratch, rounds)
    unseen = cands.filter("c.kind = -1").select("uid", "c.s", "c.e", F.lower("c.core").alias("core"))
    extra = unseen.join(found, "core").select("uid", F.struct(F.col("found").alias("kind"), "s", "e").alias("x")).groupBy("uid").agg(F.sort_array(F.collect_set("x")).alias("extra"))
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    return scanned.join(extra, "uid", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def redact(docs: DataFrame, mask: str = "x") -> DataFrame:
    """(doc_id, text) with every character of a base span but white space replaced, a kind at a time: phone numbers, cards,
    addresses, emails, each sought in what is left of the text. Contexts are not needed for it."""
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    for kind in SHIELD_ORDER:
        rows = replaced(rows, "text", kind, lambda m: F.regexp_replace(m, "\\S", mask))
    return rows.select("doc_id", "text")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == i)).cast("bigint")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.array_union("base", "extra"))).alias("spans"))

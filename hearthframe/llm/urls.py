"""URL filters by a bit-parallel wildcard automaton (extended Shift-And of Baeza-Yates, Gonnet, Navarro and Raffinot).

All glob patterns are packed one after another into words of 64 bits. Reading one character shifts the states of every
pattern at once and masks them by that character; a ``*`` is a state that keeps itself. The urls of an Arrow batch
advance together, a position at a time.

A canonical url is ``.host/path``: the host lower-cased (A to Z), the path as it is. Rules (verdict, host, path) are patterns of
the same automaton: host and path to the letter (a ``*`` in them is a ``*`` of the url), after any subdomain and before anything.
Of the rules that fit, the longest decides, of equally long ones the first listed; where none fits, a url that a block glob
fits is blocked, and any other is allowed. Rules and globs come from the constants below or from a table (``read_rules``), of
at most ``MOST_PATTERNS`` rows. Patterns are dealt to packs of ``PACK``; a pack is run over a lot of urls and only the longest rule
and the block are kept, so memory grows with a pack's states and not with the number of patterns.

Null urls and urls without ``://`` have empty host and path, fit no rule and are blocked (``INVALID``). Urls of any length are
read whole, those of a batch in bounded lots. Repeated rows are judged alike. Other columns of the input are not read
unless they are to be kept. Empty tables give empty results; an empty set of patterns fits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

#: Fixed values of the contract: verdict, host, path. The longest fitting rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs of the method's own, for urls that no rule fits. ``*`` stands for any run of characters; before the first
#: ``/`` of a glob it stands for host characters only.
HOST_WORDS = ("spam", "pills", "casino", "poker", "viagra", "porn", "escort", "warez", "phishing", "malware", "gambling", "payday-loan")
HOST_ENDS = ("xxx", "porn", "adult", "sex", "casino", "bet", "poker")
PATH_PARTS = ("phpsessid=", "jsessionid=", "/cgi-bin/", "/wp-login.php", "/wp-admin/", "/cart/", "/checkout/", "/signin/", "/logout", "/unsubscribe")
FILE_ENDS = ("exe", "msi", "dmg", "apk", "iso", "zip", "rar", "7z", "gz", "mp3", "mp4", "avi", "mkv", "wmv", "jpg", "jpeg", "png", "gif", "ico", "css", "js", "swf")
BLOCK_GLOBS = (*[f"*{w}*/*" for w in HOST_WORDS], *[f"*.{e}/*" for e in HOST_ENDS], *[f"*/*{t.removeprefix('/')}*" if not t.startswith("/") else f"*{t}*" for t in PATH_PARTS], *[f"*/*.{e}" for e in FILE_ENDS])
MOST_PATTERNS, PACK = 100_000, 256
INVALID = "block"
#: Rows of a batch that advance together; with PACK it bounds the automaton's memory whatever the batch holds.
ROWS_AT_ONCE = 4096


class GlobSet:
    """Globs, and literal texts after a subdomain (``rules``), compiled to multiword Shift-And masks. ``match`` gives a rows-by-patterns
    array of booleans, rules first."""

    def __init__(self, globs: list[str], rules: list[str] = ()):
        self.globs = [*rules, *globs]
        cells: list[tuple[str, bool, bool]] = []  # character, star before it, star may cross "/"
        starts, ends, tails = [], [], []
        for k, glob in enumerate(self.globs):
            literal = k < len(rules)
            if not literal and not glob.strip("*"):
                raise ValueError("a glob needs a character besides *")
            starts.append(len(cells))
            star, path = literal, False  # a rule stands after any subdomain
            for ch in f".{glob}" if literal else glob:
                if ch == "*" and not literal:
                    star = True
                    continue
                cells.append((ch, star, path))
                path |= ch == "/"
                star = False
            ends.append(len(cells) - 1)
            tails.append(star or literal)
        self.size = len(cells)
        self.words = max(1, -(-self.size // 64))
        self.starts, self.ends, self.tails = starts, ends, tails
        zero = lambda: np.zeros(self.words, np.uint64)

        def put(mask: np.ndarray, i: int) -> None:
            mask[i // 64] |= np.uint64(1 << (i % 64))

        self.anchored, self.floating, self.first = zero(), zero(), zero()
        self.stay_host, self.stay_path = zero(), zero()
        self.of: dict[str, np.ndarray] = {}
        for i, (ch, _, _) in enumerate(cells):
            put(self.of.setdefault(ch, zero()), i)
        for g, a in enumerate(starts):
            put(self.first, a)
            put(self.floating if cells[a][1] else self.anchored, a)
            for i in range(a, ends[g]):
                if cells[i + 1][1]:  # a star after cell i keeps state i alive
                    put(self.stay_path if cells[i + 1][2] else self.stay_host, i)
            if tails[g]:
                put(self.stay_path, ends[g])
        self.masks = np.zeros((len(self.of) + 1, self.words), np.uint64)
        self.ascii, self.beyond = np.zeros(129, np.int32), {}
        for k, (ch, mask) in enumerate(self.of.items(), 1):
            self.masks[k] = mask
            if ord(ch) < 128:
                self.ascii[ord(ch)] = k
            else:
                self.beyond[ord(ch)] = k

    def match(self, urls: list[str]) -> np.ndarray:
        out = np.zeros((len(urls), len(self.globs)), bool)
        for a in range(0, len(urls), ROWS_AT_ONCE):
            out[a : a + ROWS_AT_ONCE] = self._match(urls[a : a + ROWS_AT_ONCE])
        return out

    def _match(self, urls: list[str]) -> np.ndarray:
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        points = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        lengths = lengths[order]
        masks = self.masks
        code = self.ascii[np.minimum(points, 128)]
        for c, k in self.beyond.items():
            code[points == c] = k
        slash = points == ord("/")
        state = np.zeros((n, self.words), np.uint64)
        host = np.ones(n, bool)
        done = np.zeros((n, self.words), np.uint64)
        one = np.uint64(1)
        live = int((lengths > 0).sum())
        position = 0
        while live:
            here = begin[:live] + position
            now = state[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~self.first
            is_slash = slash[here]
            moved |= np.where(host[:live, None], self.floating, np.uint64(0))
            if position == 0:
                moved |= self.anchored
            moved &= masks[code[here]]
            in_host = host[:live] & ~is_slash
            kept = now & (self.stay_path | np.where(in_host[:, None], self.stay_host, np.uint64(0)))
            host[:live] &= ~is_slash
            state[:live] = moved | kept
            position += 1
            ended = lengths[:live] == position
            if ended.any():
                done[:live][ended] = state[:live][ended]
                live = int((lengths > position).sum())
        matched = np.zeros((n, len(self.globs)), bool)
        for g, e in enumerate(self.ends):
            matched[order, g] = (done[:, e // 64] >> np.uint64(e % 64)) & one != 0
        return matched


def canonical_parts(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cuts = [i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0]
    end = min(cuts, default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[end:]
    cuts = [i for i in (tail.find("?"), tail.find("#")) if i >= 0]
    return host, tail[: min(cuts, default=len(tail))]


Rules = tuple[tuple[str, str, str], ...]


def read_rules(patterns: DataFrame, most: int = MOST_PATTERNS) -> tuple[Rules, tuple[str, ...]]:
    """Rules and block globs from a table (verdict, host, path, glob): a row with a glob is a block glob, any other a rule.

    The table goes to every task, so a larger one than ``most`` rows is refused.
    """
    rows = patterns.select("verdict", "host", "path", "glob").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    rules = tuple((r["verdict"], r["host"].lower(), r["path"]) for r in rows if r["glob"] is None and r["host"] is not None and r["path"] is not None)
    return rules, tuple(r["glob"] for r in rows if r["glob"] is not None)


def judge(pages: DataFrame, rules: Rules = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, the longest rule that fits, and the verdict. No shuffle; masks are made once a task."""
    rules, block_globs = tuple(rules), tuple(block_globs)
    texts = [host + path for _, host, path in rules]
    # Longest first, of equal length the first listed: the first that fits decides.
    order = sorted(range(len(rules)), key=lambda i: (-len(texts[i]), i))
    packed = lambda items: [items[i : i + PACK] for i in range(0, len(items), PACK)]

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_rule = [(part, GlobSet([], [texts[i] for i in part])) for part in packed(order)]
        by_glob = [GlobSet(list(part)) for part in packed(block_globs)]
        for urls in batches:
            parts = [canonical_parts(u) for u in urls]
            rule, verdict = np.full(len(parts), None, object), np.full(len(parts), "allow", object)
            for a in range(0, len(parts), ROWS_AT_ONCE):
                lot = [f".{h}{p}" for h, p in parts[a : a + ROWS_AT_ONCE]]
                first, blocked = np.full(len(lot), -1), np.zeros(len(lot), bool)
                for part, automaton in by_rule:
                    hits = automaton.match(lot)
                    new = (first < 0) & hits.any(axis=1)
                    first[new] = np.array(part)[hits[new].argmax(axis=1)]
                for automaton in by_glob:
                    blocked |= automaton.match(lot).any(axis=1)
                for i, r in enumerate(first.tolist()):
                    h, p = parts[a + i]
                    if r >= 0:
                        rule[a + i], verdict[a + i] = texts[r], rules[r][0]
                    elif not h and not p:
                        verdict[a + i] = INVALID
                    elif blocked[i]:
                        verdict[a + i] = "block"
            yield pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": verdict})

    udf = F.pandas_udf(judged, "host string, path string, rule string, verdict string")
    base = pages.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{url}`").alias("__url"))
    made = base.withColumn("__j", udf(F.col("__url")))
    return made.select(*[F.col(f"`{k}`") for k in keep], "__j.host", "__j.path", "__j.rule", "__j.verdict")


def op10_glob_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(only(table(spark, sf_dir, "pages"), page_id="page_id", url="url"))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over a canonical url."""
    out, path = "", False
    for ch in glob:
        out += (".*" if path else "[^/]*") if ch == "*" else re.escape(ch)
        path |= ch == "/"
    return out


ORACLE_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1, 1) = '/' THEN regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') ELSE '' END AS path FROM a),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC) AS o
      FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
b AS (SELECT p.*, f.rule, f.verdict AS by_rule FROM p LEFT JOIN (SELECT * FROM f WHERE o = 1) f USING (page_id, host, path))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host = '' AND path = '' THEN 'block' WHEN regexp_full_match('.' || host || path, '__GLOBS__', 's') THEN 'block' ELSE 'allow' END) AS verdict FROM b
""".replace("__GLOBS__", "|".join(glob_regex(g) for g in BLOCK_GLOBS).replace("'", "''"))

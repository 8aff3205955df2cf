"""DuckDB expressions for the text functions. RE2 has no look-around, so such patterns are rewritten for it."""

from __future__ import annotations

from hearthframe.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return pattern.replace(r"(?=[\s,;)]|$)", r"([\s,;)]|$)").replace("(?<!un)furnished", "(^|[^n]|(^|[^u])n)furnished").replace(r"(?!\s*deposit)", "")


def says(text: str, pattern: str) -> str:
    if "(?<!real )" in pattern:
        text, pattern = f"replace({text}, 'real estate', ' ')", pattern.replace("(?<!real )", "")
    return f"coalesce(regexp_matches({text}, {q(re2(pattern))}, 'i'), false)"


def group(text: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {q(re2(pattern))}, {n}, 'i'), '')"


def case(value: str, table: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + " END"


def amount(text: str) -> str:
    s = f"replace(replace({text}, '/=', ' '), chr(160), ' ')"
    nums, units = (f"regexp_extract_all({s}, {q(T.AMOUNT)}, {g}, 'i')" for g in (1, 2))
    return f"list_max(list_transform(list_zip({nums}, {units}), lambda p: CAST(replace(p[1], ',', '') AS DOUBLE) * coalesce({case('lower(p[2])', T.MULTIPLIERS)}, 1)))"


def stated_currency(text: str) -> str:
    return f"CASE WHEN {says(text, T.USD)} THEN 'USD' WHEN {says(text, T.UGX)} THEN 'UGX' END"


def rent_factor(*texts: str) -> str:
    one = lambda t: "CASE " + " ".join(f"WHEN {says(t, p)} THEN {'-1' if f is None else repr(f)}" for p, f in T.PERIODS) + " END"
    return f"nullif(CAST(coalesce({', '.join(one(t) for t in texts)}, 1) AS DOUBLE), -1)"


def plot_value(text: str) -> str:
    s = f"replace({text}, ',', '')"
    num = lambda p, n=1: f"CAST({group(s, p, n)} AS DOUBLE)"
    d = f"{num(T.DIMENSIONS)} * {num(T.DIMENSIONS, 2)}"
    plots = f"lower({group(s, T.PLOTS)})"
    return (
        f"CASE WHEN {says(s, T.DECIMALS)} THEN {num(T.DECIMALS)} WHEN {says(s, T.ACRES)} THEN {num(T.ACRES)} * 100e0"
        f" WHEN {says(s, T.WORD_ACRES)} THEN {case(f'lower({group(s, T.WORD_ACRES)})', T.FRACTIONS)} * 100e0"
        f" WHEN {says(s, T.HECTARES)} THEN {num(T.HECTARES)} * 10000e0 / 40.4686e0"
        f" WHEN {says(s, T.DIMENSIONS)} THEN CASE WHEN starts_with(lower(coalesce({group(s, T.DIMENSIONS, 3)}, 'ft')), 'm') THEN {d} ELSE {d} * 0.09290304e0 END / 40.4686e0"
        f" WHEN {says(s, T.PLOTS)} THEN coalesce(TRY_CAST({plots} AS DOUBLE), {case(plots, T.FRACTIONS)}) * 5000e0 * 0.09290304e0 / 40.4686e0 END"
    )


def plot_method(text: str) -> str:
    s = f"replace({text}, ',', '')"
    return "CASE " + " ".join(f"WHEN {says(s, p)} THEN {q(m)}" for p, m in ((T.DECIMALS, "decimals"), (T.ACRES, "acres"), (T.WORD_ACRES, "acres_word"), (T.HECTARES, "hectares"), (T.DIMENSIONS, "dimensions"), (T.PLOTS, "plot_convention"))) + " END"


def floor_m2(text: str) -> str:
    s = f"replace({text}, ',', '')"
    return f"CASE WHEN {says(s, T.SQUARE_METRES)} THEN CAST({group(s, T.SQUARE_METRES)} AS DOUBLE) WHEN {says(s, T.SQUARE_FEET)} THEN CAST({group(s, T.SQUARE_FEET)} AS DOUBLE) * 0.09290304e0 END"


def first_of(text: str, rules: tuple, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {says(text, p)} THEN {q(n)}" for n, p in rules) + f" ELSE {q(default)} END"


def tenure(text: str) -> str:
    return first_of(f"lower({text})", T.TENURES, "unknown")


def status(text: str) -> str:
    k = tenure(text)
    return f"CASE WHEN {k} = 'kibanja' THEN 'untitled' WHEN {says(f'lower({text})', T.TITLE_PENDING)} THEN 'title_pending' WHEN {says(f'lower({text})', T.TITLED)} OR {k} IN ('mailo', 'freehold', 'leasehold') THEN 'titled' ELSE 'unknown' END"


def word_number(token: str) -> str:
    return f"coalesce(TRY_CAST(trim({token}) AS DOUBLE), {case(f'lower(trim({token}))', T.NUMBER_WORDS)})"


def months(tokens: str) -> str:
    return f"list_filter(list_transform({tokens}, lambda t: CAST(coalesce(TRY_CAST(t AS INTEGER), {case('lower(t)', T.MONTH_WORDS)}) AS INTEGER)), lambda v: v BETWEEN 1 AND 12)"


def advance(text: str) -> str:
    def stated(p: str) -> str:
        # RE2 has no negative look-ahead: what a deposit follows is renamed before the search.
        t = f"regexp_replace({text}, '(months?)(\\s*deposit)', 'month_\\2', 'gi')" if "(?!" in p else text
        p = p.replace(r"months?(?!\s*deposit)", r"months?\b") if "(?!" in p else p
        return f"list_max({months(f'regexp_extract_all({t}, {q(p)}, 1, {q("i")})')})"

    often = "CASE " + " ".join(f"WHEN {says(text, p)} THEN {m}" for p, m in T.FREQUENCIES) + " END"
    return f"CAST(coalesce({', '.join(stated(p) for p in T.ADVANCE)}, {often}) AS INTEGER)"


def deposit(text: str) -> str:
    one, two = (f"regexp_extract_all({text}, {q(T.DEPOSIT)}, {g}, 'i')" for g in (1, 2))
    merged = f"list_transform(list_zip({one}, {two}), lambda p: coalesce(nullif(p[1], ''), p[2]))"
    return f"({months(merged)})[1]"

"""Listing text to values: prices, periods, sizes, tenure, features, payment terms, names. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: suffixes, patterns, factors and word lists that results depend on. ----
MULTIPLIERS = {
    "k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "mil": 1e6, "million": 1e6, "millions": 1e6,
    "b": 1e9, "bn": 1e9, "billion": 1e9,
}
USD = r"\$|\busd\b|\bus\s?dollars?\b|\bdollars?\b"
UGX = r"ug|shs?|ush"
AMOUNT = r"(\d[\d,]*(?:\.\d+)?)\s*(k|thousand|mn|mil|millions?|m|bn|billion|b)?\b"
PERIODS = (
    (r"per\s*night|/\s*night|\bnightly\b|per\s*day\b|/\s*day\b|\bdaily\b", None),
    (r"per\s*month|/\s*m(?:on)?th\b|\bmonthly\b|\bp\.?m\.?(?=[\s,;)]|$)|a\s+month\b", 1.0),
    (r"per\s*week|\bweekly\b", 52 / 12),
    (r"per\s*(?:year|annum)|/\s*y(?:ea)?r\b|\bannual(?:ly)?\b|\bp\.a\.?(?=[\s,;)]|$)|\bpa(?=[\s,;)]|$)", 1 / 12),
    (r"per\s*quarter|\bquarterly\b", 1 / 3),
    (r"semi[- ]annual|per\s*6\s*months|every\s*6\s*months", 1 / 6),
)
DECIMAL_M2 = 40.4686
SQFT_M2 = 0.09290304
ACRE_DECIMALS = 100.0
HECTARE_M2 = 10_000.0
PLOT_SQFT = 5000
_N = r"(\d+(?:\.\d+)?)"
DIMENSIONS = rf"{_N}\s*(?:ft|feet|')?\s*(?:x|×|by|\*)\s*{_N}\s*(ft|feet|m\b|metres|meters|')?"
DECIMALS = rf"{_N}\s*(?:decimals?|decs?\b|dcml)"
ACRES = rf"{_N}\s*(?:acres?|ac\b)"
WORD_ACRES = r"\b(half|quarter|an?|one|two|three|four|five|ten)\s+(?:an?\s+)?acres?"
HECTARES = rf"{_N}\s*(?:hectares?|ha\b)"
SQUARE_METRES = rf"{_N}\s*(?:sq\.?\s*m\b|sqm|m2|m²|square\s*met)"
SQUARE_FEET = rf"{_N}\s*(?:sq\.?\s*ft|sqft|square\s*f(?:ee|oo)t)"
PLOTS = r"\b(\d+|one|two|three|four|a)\s+plots?\b"
FRACTIONS = {"half": 0.5, "quarter": 0.25, "a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "ten": 10.0}
PRICE_UNITS = (
    ("per_decimal", r"per\s*decimal|/\s*decimal|a\s+decimal\b"),
    ("per_acre", r"per\s*acre|/\s*acre|an?\s+acre\s+at\b"),
    ("per_plot", r"per\s*plot|/\s*plot|a\s+plot\b"),
)
TENURES = (
    ("kibanja", r"\bkibanja\b|\bbibanja\b|sale agreement only|\bno title\b|untitled"),
    ("mailo", r"\bmailo\b|\bmailo land\b"),
    ("leasehold", r"\blease\s*hold\b|\bleasehold\b|\blease title\b|\b(49|99)\s*(yr|year)s?\s*lease|\bkcca lease\b|\bulc lease\b"),
    ("freehold", r"\bfree\s*hold\b|\bfreehold\b"),
    ("customary", r"\bcustomary\b|certificate of customary ownership|\bcco\b"),
)
TITLED = r"\btitled?\b|ready title|clean title|land title|with title|title deed|certificate of title"
TITLE_PENDING = r"title (in|under) process|processing title|title pending|awaiting title"
FEATURES = {
    "self_contained": r"self[\s-]?contain|\bs/?c\b|en[\s-]?suite",
    "boys_quarters": r"boys?'?\s*quarters?|\bbq\b|servants?'?\s*quarters?",
    "negotiable": r"negotiab|\bneg\b|\bnego\b",
    "furnished": r"(?<!un)furnished|fully furnished",
    "gated": r"gated|(?<!real )\bestate\b|compound wall|perimeter wall|walled|fenced",
    "security": r"security|guard|askari|cctv|electric fence",
    "parking": r"parking|garage|car\s*park",
    "tarmac_access": r"tarmac|paved road|main road|off .{0,25} road|along .{0,25} road",
    "pool": r"swimming pool|\bpool\b",
    "water_tank": r"water tank|reservoir|borehole",
    "backup_power": r"generator|standby power|solar|inverter",
    "lake_view": r"lake view|lakeview|view of (?:the )?lake",
    "storeyed": r"storey|storied|story(?:ed)?|duplex|mansion|maisonette",
    "bungalow": r"bungalow",
    "apartment": r"apartment|flat\b|condominium|condo\b",
    "shell_or_incomplete": r"\bshell\b|incomplete|unfinished|lock[\s-]?up|roofing level|wall plate",
    "tiled": r"\btiled?\b|tiles",
    "mortgage_available": r"mortgage|bank financing|installments?|instalments?|payment plan",
    "muzigo": r"\bmuzigo\b|mizigo|single room|double room|\bbedsitter\b|\bbed[\s-]?sitter\b",
    "commercial_use": r"commercial|shops?\b|arcade|warehouse|office space",
}
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())}
BEDS = r"\b(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)\s*[-]?\s*(?:bed(?:room)?s?|bdrms?|br\b|bedroomed)"
BATHS = r"\b(\d{1,2}|one|two|three|four|five|six)\s*[-]?\s*(?:bath(?:room)?s?|toilets?)"
PROPERTY_TYPES = (
    ("land", r"land|plot|acre|decimal"),
    ("room", r"muzigo|single room|double room|bed[- ]?sitter|\broom\b|\brooms for rent"),
    ("commercial", r"commercial|office|shop|warehouse|hotel|arcade"),
    ("apartment", r"apartment|flat|condo"),
)
MONTH_WORDS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1}
_M = r"(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
ADVANCE = (
    rf"\b{_M}\s*(?:\([a-z0-9]+\)\s*)?months?\s*(?:rent\s*)?(?:in\s*)?(?:advance|upfront|up\s*front|prepay)",
    rf"(?:advance|upfront|up\s*front)\s*(?:payment\s*)?(?:of\s*)?{_M}\s*months?",
    rf"(?:pay|payment|paid|minimum(?:\s*of)?|min\.?|at\s*least)\s*(?:of\s*)?{_M}\s*months?(?!\s*deposit)",
    rf"\b{_M}\s*months?\s*(?:payment|minimum|required)",
)
FREQUENCIES = (
    (r"\b(?:paid|payable|payment)?\s*quarterly\b|per\s*quarter|every\s*3\s*months", 3),
    (r"half[\s-]*(?:a\s*)?year(?:ly)?|bi[\s-]*annual(?:ly)?|semi[\s-]*annual(?:ly)?|every\s*6\s*months", 6),
    (r"\b(?:paid|payable|payment)\s*(?:annually|yearly)\b|per\s*annum\b|per\s*year\b", 12),
)
DEPOSIT = rf"\b{_M}\s*months?\s*(?:security\s*)?deposit|(?:security\s*)?deposit\s*(?:of\s*)?{_M}\s*months?"
AREA_SUFFIX = r"\s+(i{1,3}|iv|v|vi|ward|central|a|b)$"
PLACE_NOISE = r"\b(road|rd|estate|hill|area|town|village|zone|near|along|off|opp\.?|behind|kampala|wakiso|mukono|uganda|division|municipality|central|trading centre|stage)\b"
PHONE = r"(?:\+?256|\b0)[\s-]?[37]\d{2}[\s-]?\d{3}[\s-]?\d{3}\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
NEGOTIABLE = r"negotiab|\bneg\b|\bnego\b"
RENT_BOUNDS = (50_000, 60_000_000)
SALE_BOUNDS = (5_000_000, 30_000_000_000)
TINY_RENT = 10_000
FX_FALLBACK = 3700.0
# ---- End of fixed values. ----


def rx(pattern: str) -> str:
    """Case-insensitive, with Unicode words as the reference semantics has them."""
    return f"(?iU){pattern}"


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(rx(pattern)), F.lit(False))


def empty_as_null(text: Column) -> Column:
    return F.when(text != "", text)


def lookup(value: Column, table: dict) -> Column:
    """A small fixed table as a CASE; null where absent."""
    return reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(value == next(iter(table)), F.lit(next(iter(table.values())))))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("/="), F.lit(" ")), F.lit(" "), F.lit(" "))


def amount(text: Column) -> Column:
    """The largest number-with-suffix of a price string; null if it has none."""
    s = _plain(text)
    numbers = F.regexp_extract_all(s, F.lit(rx(AMOUNT)), F.lit(1))
    suffixes = F.regexp_extract_all(s, F.lit(rx(AMOUNT)), F.lit(2))
    return F.array_max(F.zip_with(numbers, suffixes, lambda n, u: F.replace(n, F.lit(","), F.lit("")).cast("double") * F.coalesce(lookup(F.lower(u), MULTIPLIERS), F.lit(1.0))))


def stated_currency(text: Column) -> Column:
    s = _plain(text)
    return F.when(says(s, USD), "USD").when(says(s, UGX), "UGX")


def rent_factor(*texts: Column) -> Column:
    """Monthly multiplier by the first text that states a period; null for nightly lets; 1 if none does."""
    stated: list[Column] = []
    for t in texts:
        found = None
        for pattern, factor in PERIODS:
            hit = F.struct(F.lit(factor).cast("double").alias("factor"))
            found = F.when(says(t, pattern), hit) if found is None else found.when(says(t, pattern), hit)
        stated.append(found)
    return F.coalesce(*stated, F.struct(F.lit(1.0).alias("factor")))["factor"]


def group(text: Column, pattern: str, number: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return empty_as_null(F.regexp_extract(text, rx(pattern), number))


def plot_decimals(text: Column) -> Column:
    """struct(value, method): plot size in decimals by the most explicit statement."""
    s = F.replace(text, F.lit(","), F.lit(""))
    number = lambda p, n=1: group(s, p, n).cast("double")
    unit = F.lower(F.coalesce(group(s, DIMENSIONS, 3), F.lit("ft")))
    product = number(DIMENSIONS) * number(DIMENSIONS, 2)
    area = F.when(unit.startswith("m"), product).otherwise(product * SQFT_M2)
    plots = F.lower(group(s, PLOTS))
    count = F.coalesce(F.try_to_number(plots, F.lit("999999")).cast("double"), lookup(plots, FRACTIONS))
    of = lambda v, m: F.struct(v.alias("value"), F.lit(m).alias("method"))
    return (
        F.when(says(s, DECIMALS), of(number(DECIMALS), "decimals"))
        .when(says(s, ACRES), of(number(ACRES) * ACRE_DECIMALS, "acres"))
        .when(says(s, WORD_ACRES), of(lookup(F.lower(group(s, WORD_ACRES)), FRACTIONS) * ACRE_DECIMALS, "acres_word"))
        .when(says(s, HECTARES), of(number(HECTARES) * HECTARE_M2 / DECIMAL_M2, "hectares"))
        .when(says(s, DIMENSIONS), of(area / DECIMAL_M2, "dimensions"))
        .when(says(s, PLOTS), of(count * PLOT_SQFT * SQFT_M2 / DECIMAL_M2, "plot_convention"))
    )


def floor_m2(text: Column) -> Column:
    s = F.replace(text, F.lit(","), F.lit(""))
    return F.when(says(s, SQUARE_METRES), group(s, SQUARE_METRES).cast("double")).when(says(s, SQUARE_FEET), group(s, SQUARE_FEET).cast("double") * SQFT_M2)


def price_unit(text: Column, is_sale: Column) -> Column:
    unit = None
    for name, pattern in PRICE_UNITS:
        hit = is_sale & says(text, pattern)
        unit = F.when(hit, name) if unit is None else unit.when(hit, name)
    return unit.otherwise("total")


def first_of(text: Column, rules: tuple, default: str) -> Column:
    out = None
    for name, pattern in rules:
        out = F.when(says(text, pattern), name) if out is None else out.when(says(text, pattern), name)
    return out.otherwise(default)


def tenure(*texts: Column) -> Column:
    """struct(tenure, status) by the first rule that fits the joined texts."""
    blob = F.lower(F.concat_ws(" ", *texts))
    kind = first_of(blob, TENURES, "unknown")
    status = F.when(kind == "kibanja", "untitled").when(says(blob, TITLE_PENDING), "title_pending").when(says(blob, TITLED) | kind.isin("mailo", "freehold", "leasehold"), "titled").otherwise("unknown")
    return F.struct(kind.alias("tenure"), status.alias("status"))


def word_number(token: Column, table: dict = NUMBER_WORDS) -> Column:
    t = F.lower(F.trim(token))
    return F.coalesce(t.try_cast("double"), lookup(t, {k: float(v) for k, v in table.items()}))


def property_type(kind: Column, title: Column) -> Column:
    return first_of(F.lower(F.concat(F.coalesce(kind, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))), PROPERTY_TYPES, "house")


def _months(tokens: Column) -> Column:
    values = F.transform(tokens, lambda t: F.coalesce(t.try_cast("int"), lookup(F.lower(t), MONTH_WORDS)))
    return F.filter(values, lambda v: v.between(1, 12))


def advance_months(text: Column) -> Column:
    stated = [F.array_max(_months(F.regexp_extract_all(text, F.lit(rx(p)), F.lit(1)))) for p in ADVANCE]
    often = None
    for pattern, months in FREQUENCIES:
        often = F.when(says(text, pattern), months) if often is None else often.when(says(text, pattern), months)
    return F.coalesce(*stated, often)


def deposit_months(text: Column) -> Column:
    one, two = (F.regexp_extract_all(text, F.lit(rx(DEPOSIT)), F.lit(g)) for g in (1, 2))
    return F.get(_months(F.zip_with(one, two, lambda a, b: F.coalesce(empty_as_null(a), b))), F.lit(0))


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rx(PHONE), "[phone]"), rx(EMAIL), "[email]")


def agent_key(*parts: Column) -> Column:
    joined = F.concat_ws("|", *[empty_as_null(F.lower(F.trim(p))) for p in parts])
    return F.when(joined != "", F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))


def plain_name(name: Column) -> Column:
    """Lower case, letters and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]", " "), " +", " "))


def sound_key(name: Column) -> Column:
    """Spelling-tolerant key: l and r alike, doubled letters once."""
    return F.regexp_replace(F.translate(plain_name(name), "l", "r"), r"([a-z])\1+", "$1")


def area_key(name: Column) -> Column:
    """Sound key of an area name without its closing numeral or ward word, joined."""
    return F.replace(sound_key(F.regexp_replace(F.lower(F.trim(name)), AREA_SUFFIX, "")), F.lit(" "), F.lit(""))

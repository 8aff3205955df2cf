"""Queries over the text layer: extraction, normalisation, redaction, names, page and record parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import text as T
from hearthframe.operators import cleaning as C

from . import duck as D
from .registry import query

V1 = ("listing_raw",)
TD = "coalesce(title, '') || ' ' || coalesce(description, '')"


@query("parse_amount", f"SELECT lid, {D.amount('price_raw')} AS amount, {D.stated_currency('price_raw')} AS currency FROM listing_raw", V1)
def parse_amount(t):
    return t("listing_raw").select("lid", T.amount(F.col("price_raw")).alias("amount"), T.stated_currency(F.col("price_raw")).alias("currency"))


@query("rent_factor", f"SELECT lid, round({D.rent_factor('price_period', 'price_raw', 'title', 'description')}, 6) AS factor FROM listing_raw", V1)
def rent_factor(t):
    return t("listing_raw").select("lid", F.round(T.rent_factor(*map(F.col, ("price_period", "price_raw", "title", "description"))), 6).alias("factor"))


PRICES = f""", a AS (SELECT l.*, {D.amount('price_raw')} AS amount, {D.stated_currency('price_raw')} AS sc, nullif(regexp_extract(upper(currency_raw), '(USD|UGX)', 1), '') AS fc,
    coalesce(listing_type = 'rent', false) AS is_rent, coalesce(listing_type = 'sale', false) AS is_sale FROM listing_raw l),
  b AS (SELECT *, CASE WHEN sc = 'USD' THEN 'USD' ELSE coalesce(fc, sc, 'UGX') END AS c0 FROM a),
  c AS (SELECT *, coalesce(c0 = 'UGX' AND amount < 10000 AND is_rent, false) AS flag_currency_inferred FROM b),
  d AS (SELECT c.*, CASE WHEN flag_currency_inferred THEN 'USD' ELSE c0 END AS currency, rate FROM c LEFT JOIN fx_month f ON f.month = strftime(coalesce(listing_date, scraped_at), '%Y-%m')),
  e AS (SELECT *, CASE WHEN currency = 'USD' THEN amount * coalesce(rate, 3700) ELSE amount END AS amount_ugx,
    CASE WHEN is_rent THEN {D.rent_factor('price_period', 'price_raw', 'title', 'description')} END AS rent_period_factor FROM d),
  prices AS (SELECT *, is_rent AND rent_period_factor IS NULL AS flag_short_stay, CASE WHEN is_rent THEN amount_ugx * rent_period_factor END AS rent_month_ugx, CASE WHEN is_sale THEN amount_ugx END AS price_ugx,
    {D.says(f'lower({TD})', T.NEGOTIABLE)} AS flag_negotiable, amount IS NULL OR regexp_matches(lower({TD}), 'price on request|call for price') AS flag_price_missing FROM e),
  priced AS (SELECT *, ((is_rent AND NOT coalesce(rent_month_ugx BETWEEN 50000 AND 60000000, false)) OR (is_sale AND NOT coalesce(price_ugx BETWEEN 5000000 AND 30000000000, false))) AND NOT flag_price_missing AS flag_price_outlier FROM prices)
"""


@query(
    "normalise_prices",
    PRICES + " SELECT lid, amount, currency, flag_currency_inferred, round(amount_ugx, 4) AS amount_ugx, flag_short_stay, round(rent_month_ugx, 4) AS rent_month_ugx, price_ugx, flag_negotiable, flag_price_missing, flag_price_outlier FROM priced",
    ("listing_raw", "fx_month"),
)
def normalise_prices(t):
    out = C.normalise_prices(t("listing_raw"), t("fx_month"))
    return out.select("lid", "amount", "currency", "flag_currency_inferred", F.round("amount_ugx", 4).alias("amount_ugx"), "flag_short_stay", F.round("rent_month_ugx", 4).alias("rent_month_ugx"), "price_ugx", "flag_negotiable", "flag_price_missing", "flag_price_outlier")


@query("plot_size", f"SELECT lid, round({D.plot_value('description')}, 6) AS value, {D.plot_method('description')} AS method FROM listing_raw", V1)
def plot_size(t):
    s = T.plot_decimals(F.col("description"))
    return t("listing_raw").select("lid", F.round(s["value"], 6).alias("value"), s["method"].alias("method"))


@query("floor_area", f"SELECT lid, round({D.floor_m2('description')}, 6) AS floor_m2 FROM listing_raw", V1)
def floor_area(t):
    return t("listing_raw").select("lid", F.round(T.floor_m2(F.col("description")), 6).alias("floor_m2"))


FIELD = "coalesce(size_raw, '') || ' ' || coalesce(size_unit_raw, '')"
SIZES = f""", f AS (SELECT *, {D.plot_value(FIELD)} AS fv, {D.plot_method(FIELD)} AS fm, {D.plot_value(TD)} AS tv, {D.plot_method(TD)} AS tm, {D.floor_m2(TD)} AS floor_m2,
    CASE WHEN source = 'alpha' AND size_unit_raw = 'sqm' THEN TRY_CAST(size_raw AS DOUBLE) END AS portal_size_sqm FROM listing_raw),
  g AS (SELECT *, CASE WHEN fv IS NOT NULL THEN fv ELSE tv END AS v, CASE WHEN fv IS NOT NULL THEN fm ELSE tm END AS m FROM f),
  sized AS (SELECT *, coalesce(NOT v BETWEEN 0.5 AND 5000, false) AS flag_plot_implausible, CASE WHEN v >= 0.5 THEN v END AS plot_decimals, CASE WHEN v >= 0.5 THEN m END AS plot_method FROM g)
"""


@query("normalise_sizes", SIZES + " SELECT lid, round(floor_m2, 6) AS floor_m2, portal_size_sqm, flag_plot_implausible, round(plot_decimals, 6) AS plot_decimals, plot_method FROM sized", V1)
def normalise_sizes(t):
    return C.normalise_sizes(t("listing_raw")).select("lid", F.round("floor_m2", 6).alias("floor_m2"), "portal_size_sqm", "flag_plot_implausible", F.round("plot_decimals", 6).alias("plot_decimals"), "plot_method")


WORDS = "coalesce(price_period, '') || ' ' || coalesce(price_raw, '') || ' ' || coalesce(title, '')"
UNITS = f""", u AS (SELECT *, CASE WHEN coalesce(listing_type = 'sale', false) THEN {D.first_of(WORDS, T.PRICE_UNITS, 'total')} ELSE 'total' END AS price_unit FROM sized),
  united AS (SELECT * EXCLUDE (plot_decimals, plot_method), CASE price_unit WHEN 'per_plot' THEN coalesce(CASE WHEN {D.says(TD, T.DIMENSIONS)} THEN tv END, 5000 * 0.09290304e0 / 40.4686e0) WHEN 'per_acre' THEN 100e0 WHEN 'per_decimal' THEN 1e0 ELSE plot_decimals END AS plot_decimals,
    CASE price_unit WHEN 'per_plot' THEN 'per_plot_price' WHEN 'per_acre' THEN 'per_acre_price' WHEN 'per_decimal' THEN 'per_decimal_price' ELSE plot_method END AS plot_method FROM u)
"""


@query("price_unit", SIZES + UNITS + " SELECT lid, price_unit, round(plot_decimals, 6) AS plot_decimals, plot_method FROM united", V1)
def price_unit(t):
    return C.apply_price_units(C.normalise_sizes(t("listing_raw"))).select("lid", "price_unit", F.round("plot_decimals", 6).alias("plot_decimals"), "plot_method")


@query("tenure", f"SELECT lid, {D.tenure('description')} AS tenure, {D.status('description')} AS status FROM listing_raw", V1)
def tenure(t):
    return t("listing_raw").select("lid", T.tenure(F.col("description")).alias("t")).select("lid", "t.*")


DOT = "lower(coalesce(title, '') || ' . ' || coalesce(description, ''))"
FLAGS = {n: f"CAST({D.says(DOT, p)} AS INTEGER)" for n, p in T.FEATURES.items()}
FLAGS["furnished"] = f"CASE WHEN starts_with(lower(coalesce(furnishing_raw, '')), 'unfurn') THEN 0 WHEN starts_with(lower(coalesce(furnishing_raw, '')), 'furn') THEN 1 ELSE {FLAGS['furnished']} END"


@query("text_features", f"SELECT lid, {', '.join(f'{e} AS f_{n}' for n, e in FLAGS.items())} FROM listing_raw", V1)
def text_features(t):
    return C.extract_features(t("listing_raw")).select("lid", *[f"f_{n}" for n in T.FEATURES])


BEDS = f""", b AS (SELECT *, {D.word_number('bedrooms_raw')} AS fb, {D.word_number(D.group(DOT, T.BEDS))} AS tb, TRY_CAST(trim(bathrooms_raw) AS DOUBLE) AS fh, {D.word_number(D.group(DOT, T.BATHS))} AS th,
    {FLAGS['muzigo']} AS muzigo, concat_ws(' ', title, description, tenure_raw) AS tt, coalesce(trim(tenure_raw) <> '', false) AS has_field FROM listing_raw),
  c AS (SELECT *, coalesce(fb, tb, CASE WHEN muzigo = 1 THEN 0.5e0 END) AS beds, coalesce(fh, th) AS baths, CASE WHEN has_field THEN {D.tenure('tenure_raw')} ELSE 'unknown' END AS ft, {D.tenure('tt')} AS xt, {D.status('tt')} AS title_status FROM b),
  bedded AS (SELECT *, CASE WHEN ft <> 'unknown' THEN ft ELSE xt END AS tenure_class FROM c)
"""


@query(
    "bedrooms",
    BEDS + " SELECT lid, CASE WHEN beds <= 15 THEN beds END AS bedrooms, CASE WHEN fb IS NOT NULL THEN 'portal_field' WHEN tb IS NOT NULL THEN 'text' ELSE 'none' END AS bedrooms_source, CASE WHEN baths <= 15 THEN baths END AS bathrooms,"
    " coalesce(beds > 15, false) AS flag_bedrooms_implausible, tenure_class, title_status, CASE WHEN has_field THEN 'portal_field' WHEN tenure_class <> 'unknown' THEN 'text' ELSE 'none' END AS tenure_source FROM bedded",
    V1,
)
def bedrooms(t):
    return C.extract_features(t("listing_raw")).select("lid", "bedrooms", "bedrooms_source", "bathrooms", "flag_bedrooms_implausible", "tenure_class", "title_status", "tenure_source")


@query("property_type", f"SELECT lid, {D.first_of("lower(coalesce(property_type, '') || ' ' || coalesce(title, ''))", T.PROPERTY_TYPES, 'house')} AS ptype FROM listing_raw", V1)
def property_type(t):
    return t("listing_raw").select("lid", T.property_type(F.col("property_type"), F.col("title")).alias("ptype"))


TERMS = f""", pt AS (SELECT *, {D.advance(TD)} AS advance_months, {D.deposit(TD)} AS deposit_months FROM listing_raw),
  terms AS (SELECT *, CAST(advance_months IS NOT NULL OR deposit_months IS NOT NULL AS INTEGER) AS terms_stated,
    CASE WHEN advance_months IS NOT NULL OR deposit_months IS NOT NULL THEN coalesce(advance_months, 0) + coalesce(deposit_months, 0) END AS upfront_months FROM pt)
"""


@query("payment_terms", TERMS + " SELECT lid, CAST(advance_months AS DOUBLE) AS advance_months, CAST(deposit_months AS DOUBLE) AS deposit_months, terms_stated, CAST(upfront_months AS DOUBLE) AS upfront_months FROM terms", V1)
def payment_terms(t):
    number = lambda c: F.col(c).cast("double").alias(c)
    return C.payment_terms(t("listing_raw")).select("lid", number("advance_months"), number("deposit_months"), "terms_stated", number("upfront_months"))


@query(
    "upfront_cash",
    PRICES + f""", x AS (SELECT p.*, {D.advance(TD)} AS am FROM priced p WHERE is_rent AND rent_month_ugx IS NOT NULL AND NOT flag_price_outlier),
  y AS (SELECT am, rent_month_ugx, CASE WHEN rent_month_ugx <= 500000 THEN '1 low' WHEN rent_month_ugx <= 5000000 THEN '2 middle' ELSE '3 high' END AS segment FROM x)
  SELECT coalesce(segment, 'all rentals') AS segment, CAST(count(*) AS BIGINT) AS n, CAST(count(am) AS BIGINT) AS n_stated, round(quantile_cont(am, 0.5), 4) AS median_months, round(quantile_cont(rent_month_ugx * coalesce(am, 1), 0.5), 2) AS median_cash
  FROM y GROUP BY GROUPING SETS ((segment), ())""",
    ("listing_raw", "fx_month"),
)
def upfront_cash(t):
    p = C.payment_terms(C.normalise_prices(t("listing_raw"), t("fx_month"))).filter("listing_type = 'rent' AND rent_month_ugx IS NOT NULL AND NOT flag_price_outlier")
    seg = F.when(F.col("rent_month_ugx") <= 500_000, "1 low").when(F.col("rent_month_ugx") <= 5_000_000, "2 middle").otherwise("3 high")
    cash = F.percentile(F.col("rent_month_ugx") * F.coalesce("advance_months", F.lit(1)), 0.5)
    out = p.withColumn("segment", seg).groupingSets([[F.col("segment")], []], F.col("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count("advance_months").alias("n_stated"), F.round(F.percentile("advance_months", 0.5), 4).alias("median_months"), F.round(cash, 2).alias("median_cash")
    )
    return out.withColumn("segment", F.coalesce("segment", F.lit("all rentals")))


@query(
    "usd_share",
    PRICES + " SELECT coalesce(listing_type, 'unknown') AS market, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(currency = 'USD' AS DOUBLE)), 6) AS usd_share FROM priced WHERE NOT flag_price_missing GROUP BY 1",
    ("listing_raw", "fx_month"),
)
def usd_share(t):
    p = C.normalise_prices(t("listing_raw"), t("fx_month")).filter("NOT flag_price_missing")
    return p.groupBy(F.coalesce("listing_type", F.lit("unknown")).alias("market")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("currency") == "USD").cast("double")), 6).alias("usd_share"))


@query("redact", f"SELECT lid, regexp_replace(regexp_replace(description, {D.q(T.PHONE)}, '[phone]', 'g'), {D.q(T.EMAIL)}, '[email]', 'g') AS description FROM listing_raw", V1)
def redact(t):
    return t("listing_raw").select("lid", T.redact(F.col("description")).alias("description"))


@query("agent_key", "SELECT lid, substr(sha256(source || '|' || agent), 1, 16) AS agent_key FROM listing_raw", V1)
def agent_key(t):
    return t("listing_raw").select("lid", T.agent_key(F.col("source"), F.col("agent")).alias("agent_key"))


_FOLD = "[" + ", ".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
SOUND = "list_aggregate(list_transform(list_filter(range(1, length({0}) + 1), lambda i: i = 1 OR substr({0}, CAST(i AS INT), 1) <> substr({0}, CAST(i AS INT) - 1, 1) OR substr({0}, CAST(i AS INT), 1) = ' '), lambda i: substr({0}, CAST(i AS INT), 1)), 'string_agg', '')"


@query(
    "name_keys",
    f""", n AS (SELECT c_custkey AS id, n_name || CASE c_custkey % 4 WHEN 0 THEN ' II' WHEN 1 THEN ' Ward' WHEN 2 THEN '-Hill' ELSE ' B' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z]', ' ', 'g'), ' +', ' ', 'g')) AS plain,
     translate(trim(regexp_replace(regexp_replace(lower(regexp_replace(lower(trim(name)), '{T.AREA_SUFFIX}', '')), '[^a-z]', ' ', 'g'), ' +', ' ', 'g')), 'l', 'r') AS cut FROM n),
  s AS (SELECT *, translate(plain, 'l', 'r') AS r FROM p)
  SELECT id, plain, {SOUND.format('r')} AS sound, replace({SOUND.format('cut')}, ' ', '') AS area FROM s""".replace(", n AS", "WITH n AS", 1),
)
def name_keys(t):
    suffix = F.when(F.col("c_custkey") % 4 == 0, " II").when(F.col("c_custkey") % 4 == 1, " Ward").when(F.col("c_custkey") % 4 == 2, "-Hill").otherwise(" B")
    n = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat("n_name", suffix).alias("name"))
    return n.select("id", T.plain_name(F.col("name")).alias("plain"), T.sound_key(F.col("name")).alias("sound"), T.area_key(F.col("name")).alias("area"))


@query(
    "cleaning_log",
    PRICES + """, k AS (SELECT count(*) AS n0, count(*) FILTER (WHERE NOT flag_short_stay) AS n1, count(*) FILTER (WHERE NOT flag_short_stay AND NOT flag_price_missing) AS n2,
    count(*) FILTER (WHERE NOT flag_short_stay AND NOT flag_price_missing AND (is_rent OR is_sale)) AS n3, count(*) FILTER (WHERE NOT flag_short_stay AND NOT flag_price_missing AND (is_rent OR is_sale) AND NOT flag_price_outlier) AS n4 FROM priced)
  SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS step, unnest(['raw', 'not short stay', 'priced', 'rent or sale', 'not an outlier']) AS label, CAST(unnest([n0, n1, n2, n3, n4]) AS BIGINT) AS n FROM k""",
    ("listing_raw", "fx_month"),
)
def cleaning_log(t):
    p = C.normalise_prices(t("listing_raw"), t("fx_month"))
    return C.cleaning_log(p, [("not short stay", ~F.col("flag_short_stay")), ("priced", ~F.col("flag_price_missing")), ("rent or sale", F.col("listing_type").isin("rent", "sale")), ("not an outlier", ~F.col("flag_price_outlier"))])


@query(
    "derive_measures",
    PRICES.replace("FROM listing_raw l)", f", {D.word_number('bedrooms_raw')} AS beds0 FROM listing_raw l)")
    + """, m AS (SELECT *, CASE WHEN beds0 <= 15 AND beds0 > 0 THEN beds0 END AS beds, coalesce(listing_date, scraped_at) AS day FROM priced)
  SELECT lid, round(rent_month_ugx / beds, 4) AS rent_per_bedroom, round(price_ugx / beds, 4) AS price_per_bedroom, round(CASE WHEN rent_month_ugx > 0 THEN ln(rent_month_ugx) END, 6) AS log_rent,
    strftime(day, '%Y-%m') AS month, CAST(year(day) AS VARCHAR) || 'Q' || CAST(quarter(day) AS VARCHAR) AS quarter FROM m""",
    ("listing_raw", "fx_month"),
)
def derive_measures(t):
    p = C.normalise_prices(t("listing_raw"), t("fx_month")).withColumn("b", T.word_number(F.col("bedrooms_raw"))).withColumns({"bedrooms": F.when((F.col("b") <= 15) & (F.col("b") > 0), F.col("b")), "plot_decimals": F.lit(None).cast("double")})
    return C.derive_measures(p).select("lid", F.round("rent_per_bedroom", 4).alias("rent_per_bedroom"), F.round("price_per_bedroom", 4).alias("price_per_bedroom"), F.round("log_rent", 6).alias("log_rent"), "month", "quarter")

"""Queries over the affordability indices and policy scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import finance as fin
from hearthframe.operators import index as X

from .registry import query

VIEWS = ("index_listings", "parish_income")
B = fin.BASE_TERMS


def rounded(df, keys, values, n=6):
    return df.select(*keys, *[F.round(v, n).alias(v) for v in values])


def _r(values, n=6):
    return ", ".join(f"round({v}, {n}) AS {v}" for v in values)


BASE = f""", hh AS (SELECT quantile_cont(hh_size, 0.5) AS typical FROM parish_income WHERE income > 0),
  inc AS (SELECT p.*, {2**0.5!r}e0 * ({fin.phi_inverse_sql('((gini + 1) / 2)')}) AS sigma, 87000e0 * 0.787e0 * coalesce(hh_size, typical) * (1 - 0.174e0) AS nonhousing_min FROM parish_income p, hh WHERE income > 0 AND gini IS NOT NULL),
  tinc AS (SELECT *, 'total' AS level, 'TOTAL' AS area FROM inc UNION ALL SELECT *, 'district', district FROM inc UNION ALL SELECT *, 'subcounty', district || '/' || subcounty FROM inc),
  il AS (SELECT district, subcounty, CASE WHEN listing_type = 'rent' AND bedrooms BETWEEN 0.5 AND 2 THEN rent_month END AS r, CASE WHEN listing_type = 'sale' AND ptype IN ('house', 'apartment') THEN price END AS p FROM index_listings),
  til AS (SELECT *, 'total' AS level, 'TOTAL' AS area FROM il UNION ALL SELECT *, 'district', district FROM il UNION ALL SELECT *, 'subcounty', district || '/' || subcounty FROM il),
  ai AS (SELECT level, area, sum(households) AS households, exp(sum(households * ln(income)) / sum(households)) AS median_income, exp(sum(households * ln(nonhousing_min)) / sum(households)) AS typical_min FROM tinc GROUP BY 1, 2),
  am0 AS (SELECT level, area, CAST(count(r) AS BIGINT) AS n_rent, CAST(count(p) AS BIGINT) AS n_sale, quantile_cont(r, 0.5) AS r0, quantile_cont(p, 0.5) AS p0 FROM til GROUP BY 1, 2),
  am AS (SELECT level, area, n_rent, n_sale, CASE WHEN n_rent >= 20 THEN r0 END AS median_rent, CASE WHEN n_sale >= 20 THEN p0 END AS median_price FROM am0),
  base AS (SELECT ai.*, n_rent, n_sale, median_rent, median_price, median_rent / 0.30e0 AS rent_income_needed, {fin.payment_sql('median_price * 0.7e0', '0.18293e0', '20')} AS monthly_payment FROM ai LEFT JOIN am USING (level, area)),
  based AS (SELECT *, monthly_payment / 0.35e0 AS own_income_needed FROM base)
"""


def share(q: str) -> str:
    return f"sum(i.households * {fin.phi_sql(f'((ln({q}) - ln(i.income)) / i.sigma)')}) / sum(CASE WHEN {q} IS NOT NULL THEN i.households END)"


SHARES = BASE + f""", sh AS (SELECT level, area, {share('rent_income_needed')} AS agi_rent, {share('own_income_needed')} AS agi_own, {share('(median_rent + i.nonhousing_min)')} AS ri_rent, {share('(monthly_payment + i.nonhousing_min)')} AS ri_own, {share('i.nonhousing_min')} AS below_nonhousing_min
    FROM based JOIN (SELECT level, area, households, income, sigma, nonhousing_min FROM tinc) i USING (level, area) GROUP BY 1, 2),
  ix AS (SELECT b.*, sh.* EXCLUDE (level, area), 100 * median_income / rent_income_needed AS rai, 100 * median_income / own_income_needed AS oai, ri_rent - below_nonhousing_min AS ri_rent_housing_induced, ri_own - below_nonhousing_min AS ri_own_housing_induced, median_income - median_rent - typical_min AS ri_rent_median_residual FROM based b JOIN sh USING (level, area))
"""
# A column of the outer name inside an aggregate must be the area's own; DuckDB resolves it from based.
INDEX_VALUES = ["households", "median_income", "median_rent", "median_price", "rent_income_needed", "own_income_needed", "monthly_payment", "rai", "oai", "agi_rent", "agi_own"]


def _index(name: str, level: str):
    sql = SHARES.replace("households, income, sigma, nonhousing_min FROM tinc", "households AS households, income, sigma, nonhousing_min FROM tinc").replace("FROM based JOIN", "FROM (SELECT level, area, median_rent, monthly_payment, rent_income_needed, own_income_needed FROM based) b JOIN")
    body = sql + f" SELECT area, n_rent, n_sale, {_r(INDEX_VALUES, 4)} FROM ix WHERE level = '{level}'"

    @query(name, body, VIEWS)
    def run(t):
        return rounded(X.area_index(t("index_listings"), t("parish_income"), (level,)), ["area", "n_rent", "n_sale"], INDEX_VALUES, 4)

    return sql


FULL = _index("affordability_index_district", "district")
_index("affordability_index_subcounty", "subcounty")
_index("affordability_index_total", "total")

RI = ["ri_rent", "ri_own", "below_nonhousing_min", "ri_rent_housing_induced", "ri_own_housing_induced", "ri_rent_median_residual"]


@query("residual_income", FULL + f" SELECT level, area, {_r(RI, 5)} FROM ix", VIEWS)
def residual_income(t):
    return rounded(X.area_index(t("index_listings"), t("parish_income")), ["level", "area"], RI, 5)


INC = "(SELECT level, area, households, income, sigma, nonhousing_min FROM tinc) i USING (level, area)"
GRADIENT = ["agi_rent", "agi_own", "median_hh_rent_burden", "median_hh_own_burden"]


@query(
    "burden_gradient",
    BASE + f""", grid AS (SELECT level, area, median_income, median_rent, monthly_payment, (s * 5 + 10) / 100e0 AS burden FROM based, range(15) g(s) WHERE level <> 'subcounty' AND n_rent IS NOT NULL),
  gs AS (SELECT level, area, burden, {share('(median_rent / burden)')} AS agi_rent, {share('(monthly_payment / burden)')} AS agi_own FROM grid JOIN {INC} GROUP BY 1, 2, 3)
  SELECT level, area, burden, round(agi_rent, 6) AS agi_rent, round(agi_own, 6) AS agi_own, round(median_rent / median_income, 6) AS median_hh_rent_burden, round(monthly_payment / median_income, 6) AS median_hh_own_burden FROM grid JOIN gs USING (level, area, burden)""",
    VIEWS,
)
def burden_gradient(t):
    return rounded(X.burden_gradient(t("index_listings"), t("parish_income")), ["level", "area", "burden"], GRADIENT)


SENSITIVITY = [{"scenario": n, **{**B, **c}} for n, c in (("base", {}), ("rate 16%", {"rate": 0.16}), ("rate 22%", {"rate": 0.22}), ("deposit 20%", {"deposit": 0.20}), ("deposit 50%", {"deposit": 0.50}), ("15 years", {"term": 15}), ("25 years", {"term": 25}), ("cap 30%", {"cap": 0.30}))]


def scenarios_sql(rows: list[dict]) -> str:
    cols = list(rows[0])
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{float(v)!r}e0"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(r[c]) for c in cols) + ")" for r in rows) + ") s(" + ", ".join(cols) + ")"


@query(
    "mortgage_sensitivity",
    BASE + f""", g AS (SELECT level, area, median_income, scenario, {fin.payment_sql('median_price * (1 - deposit)', 'rate', 'term')} / cap AS q FROM based, {scenarios_sql(SENSITIVITY)} WHERE level <> 'subcounty'),
  gs AS (SELECT level, area, scenario, {share('q')} AS agi_own FROM g JOIN {INC} GROUP BY 1, 2, 3)
  SELECT level, area, scenario, round(q, 4) AS own_income_needed, round(100 * median_income / q, 6) AS oai, round(agi_own, 6) AS agi_own FROM g JOIN gs USING (level, area, scenario)""",
    VIEWS,
)
def mortgage_sensitivity(t):
    levels = ("total", "district")
    inc = X.parish_incomes(t("parish_income"))
    base = X.area_incomes(inc, levels).join(X.area_medians(t("index_listings"), levels), ["level", "area"], "left")
    g = X.scenario_table(base, SENSITIVITY).withColumn("own_income_needed", fin.qualifying_income(F.col("median_price"), F.col("rate"), F.col("deposit"), F.col("term"), F.col("cap")))
    keys = ["level", "area", "scenario"]
    shares = X.mixture_shares(g.select(*keys, "own_income_needed"), inc, keys, {"agi_own": F.col("own_income_needed")}, levels)
    out = g.join(shares, keys).withColumn("oai", 100 * F.col("median_income") / F.col("own_income_needed"))
    return out.select(*keys, F.round("own_income_needed", 4).alias("own_income_needed"), F.round("oai", 6).alias("oai"), F.round("agi_own", 6).alias("agi_own"))


UNIT_VALUES = ["median_rent", "median_price", "median_income", "rent_to_income", "price_to_income", "share_can_afford", "share_cannot_afford", "income_needed", "affordability_gap", "households_cannot_afford"]
UNIT_SQL = BASE + f""", ul AS (SELECT district || '/' || subcounty AS unit, quantile_cont(CASE WHEN listing_type = 'rent' THEN rent_month END, 0.5) AS median_rent, count(*) FILTER (WHERE listing_type = 'rent') AS n_rent,
    quantile_cont(CASE WHEN listing_type = 'sale' AND ptype <> 'land' THEN price END, 0.5) AS median_price, count(*) FILTER (WHERE listing_type = 'sale' AND ptype <> 'land') AS n_sale, min(district) AS income_unit FROM index_listings GROUP BY 1),
  ui AS (SELECT district || '/' || subcounty AS unit, exp(sum(households * ln(income)) / sum(households)) AS median_income, max(sigma) AS sigma, sum(households) AS households FROM inc GROUP BY 1),
  u0 AS (SELECT ui.*, ul.* EXCLUDE (unit), CASE WHEN n_rent >= 5 THEN 1 - {fin.phi_sql('((ln(median_rent / 0.30e0) - ln(median_income)) / sigma)')} END AS share_can_afford FROM ui LEFT JOIN ul USING (unit)),
  u AS (SELECT *, 1 - share_can_afford AS share_cannot_afford, CASE WHEN n_rent >= 5 THEN median_rent / median_income END AS rent_to_income, CASE WHEN n_sale >= 5 THEN median_price / (12 * median_income) END AS price_to_income, median_rent / 0.30e0 AS income_needed,
    median_rent / 0.30e0 - median_income AS affordability_gap, households * (1 - share_can_afford) AS households_cannot_afford FROM u0)
"""


@query("affordability_by_unit", UNIT_SQL + f" SELECT unit, CAST(n_rent AS BIGINT) AS n_rent, CAST(n_sale AS BIGINT) AS n_sale, income_unit, {_r(UNIT_VALUES, 4)} FROM u", VIEWS)
def affordability_by_unit(t):
    return rounded(X.affordability_by_unit(t("index_listings"), t("parish_income")), ["unit", "n_rent", "n_sale", "income_unit"], UNIT_VALUES, 4)


@query(
    "district_summary",
    UNIT_SQL + " SELECT income_unit, CAST(count(*) AS BIGINT) AS units, CAST(sum(n_rent) AS BIGINT) AS rent_listings, round(sum(share_cannot_afford * households) / sum(households), 6) AS share_cannot_afford, round(exp(sum(ln(median_income) * households) / sum(households)), 4) AS median_income_units, round(sum(households_cannot_afford), 2) AS households_cannot_afford FROM u WHERE share_cannot_afford IS NOT NULL GROUP BY 1",
    VIEWS,
)
def district_summary(t):
    s = X.district_summary(X.affordability_by_unit(t("index_listings"), t("parish_income")))
    return s.select("income_unit", "units", "rent_listings", F.round("share_cannot_afford", 6).alias("share_cannot_afford"), F.round("median_income_units", 4).alias("median_income_units"), F.round("households_cannot_afford", 2).alias("households_cannot_afford"))


@query(
    "income_position",
    FULL + """ SELECT level, area, round(1 - agi_rent, 6) AS share_able, round((1 - agi_rent) * households, 3) AS households_able, round(100 * agi_rent, 5) AS percentile_needed FROM ix WHERE n_rent >= 20""",
    VIEWS,
)
def income_position(t):
    ix = X.area_index(t("index_listings"), t("parish_income")).filter("n_rent >= 20")
    return ix.select("level", "area", F.round(1 - F.col("agi_rent"), 6).alias("share_able"), F.round((1 - F.col("agi_rent")) * F.col("households"), 3).alias("households_able"), F.round(100 * F.col("agi_rent"), 5).alias("percentile_needed"))


@query(
    "z_distance",
    BASE + """, m AS (SELECT level, area, sum(households * ln(income)) / sum(households) AS mu, sum(households * (sigma * sigma + ln(income) * ln(income))) / sum(households) AS m2 FROM tinc GROUP BY 1, 2)
  SELECT level, area, round((ln(rent_income_needed) - mu) / sqrt(m2 - mu * mu), 6) AS z_distance FROM based JOIN m USING (level, area)""",
    VIEWS,
)
def z_distance(t):
    ix = X.area_index(t("index_listings"), t("parish_income")).select("level", "area", "rent_income_needed")
    return X.z_distance(ix, X.parish_incomes(t("parish_income")), "rent_income_needed").select("level", "area", F.round("z_distance", 6).alias("z_distance"))


@query("mixture_quantile")
def mixture_quantile(t):
    return X.mixture_quantile(X.parish_incomes(t("parish_income")), 0.9, ("total", "district")).withColumn("quantile", F.round("quantile", 3))


@query("what_if_rent", BASE + f""", c AS (SELECT level, area, median_rent * 1.1e0 AS cost FROM based WHERE level <> 'subcounty' AND n_rent IS NOT NULL) SELECT level, area, round(cost, 4) AS cost, round({share('(cost + i.nonhousing_min)')}, 6) AS share_out FROM c JOIN {INC} GROUP BY level, area, cost""", VIEWS)
def what_if_rent(t):
    return rounded(X.what_if(t("index_listings"), t("parish_income"), "rent", "residual", price_percent=110.0).withColumn("cost", F.round("cost", 4)), ["level", "area", "cost"], ["share_out"])


@query("what_if_own", BASE + f""", c AS (SELECT level, area, {fin.payment_sql('median_price * 0.9e0 * 0.8e0', '0.12e0', '25')} AS cost FROM based WHERE level <> 'subcounty' AND n_rent IS NOT NULL) SELECT level, area, round(cost, 4) AS cost, round({share('(cost / 0.35e0)')}, 6) AS share_out FROM c JOIN {INC} GROUP BY level, area, cost""", VIEWS)
def what_if_own(t):
    return rounded(X.what_if(t("index_listings"), t("parish_income"), "own", "ratio", 0.35, 0.12, 0.20, 25, 90.0).withColumn("cost", F.round("cost", 4)), ["level", "area", "cost"], ["share_out"])


@query("price_surface", BASE + f""" SELECT s * 2 / 100e0 AS price_share, (20 + 5 * r) / 1000e0 AS rate, round(100 * median_income / ({fin.payment_sql('median_price * (s * 2 / 100e0) * 0.7e0', '((20 + 5 * r) / 1000e0)', '20')} / 0.35e0), 6) AS oai FROM based, range(1, 51) a(s), range(45) b(r) WHERE level = 'total'""", VIEWS)
def price_surface(t):
    base = X.area_incomes(X.parish_incomes(t("parish_income")), ("total",)).join(X.area_medians(t("index_listings"), ("total",)), ["level", "area"])
    g = base.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(44)))).withColumns({"price_share": F.col("s") * 2 / 100, "rate": (20 + 5 * F.col("r")) / 1000})
    q = fin.qualifying_income(F.col("median_price") * F.col("price_share"), F.col("rate"), B["deposit"], B["term"], B["cap"])
    return g.select("price_share", "rate", F.round(100 * F.col("median_income") / q, 6).alias("oai"))


LADDER = [{"scenario": n, "price_factor": f, "rate": r, "term": y} for n, f, r, y in (("0 base", 1.0, B["rate"], 20), ("1 longer term", 1.0, B["rate"], 25), ("2 rate 12%", 1.0, 0.12, 25), ("3 rate 8%", 1.0, 0.08, 25), ("4 free land", 0.44, 0.08, 25), ("5 small home", 0.2, 0.08, 25), ("6 smallest home", 0.12, 0.08, 25))]


@query(
    "policy_ladder",
    BASE + f""", g AS (SELECT level, area, median_income, households, scenario, {fin.payment_sql('median_price * price_factor * 0.7e0', 'rate', 'term')} / 0.35e0 AS q FROM based, {scenarios_sql(LADDER)} WHERE level <> 'subcounty'),
  gs AS (SELECT level, area, scenario, 1 - {share('q')} AS share_able FROM g JOIN {INC} GROUP BY 1, 2, 3)
  SELECT level, area, scenario, round(q, 4) AS income_needed, round(100 * median_income / q, 6) AS oai, round(share_able, 6) AS share_able, round(share_able * households, 3) AS households_able FROM g JOIN gs USING (level, area, scenario)""",
    VIEWS,
)
def policy_ladder(t):
    levels, keys = ("total", "district"), ["level", "area", "scenario"]
    inc = X.parish_incomes(t("parish_income"))
    base = X.area_incomes(inc, levels).join(X.area_medians(t("index_listings"), levels), ["level", "area"], "left")
    g = X.scenario_table(base, LADDER).withColumn("income_needed", fin.qualifying_income(F.col("median_price") * F.col("price_factor"), F.col("rate"), B["deposit"], F.col("term"), B["cap"]))
    s = X.mixture_shares(g.select(*keys, "income_needed"), inc, keys, {"out": F.col("income_needed")}, levels)
    o = g.join(s, keys)
    return o.select(*keys, F.round("income_needed", 4).alias("income_needed"), F.round(100 * F.col("median_income") / F.col("income_needed"), 6).alias("oai"), F.round(1 - F.col("out"), 6).alias("share_able"), F.round((1 - F.col("out")) * F.col("households"), 3).alias("households_able"))


P100 = [{"terms": n, **{**B, **c}} for n, c in (("base", {}), ("concessional", {"rate": 0.08, "term": 25}), ("concessional, 10% deposit", {"rate": 0.08, "term": 25, "deposit": 0.10}))]


@query("price_for_100", BASE + f", g AS (SELECT level, area, median_price, median_income, terms, {fin.payment_sql('(1 - deposit)', 'rate', 'term')} / cap AS unit FROM based, {scenarios_sql(P100)}) SELECT level, area, terms, round(median_income / unit, 2) AS price_oai_100, round(median_income / unit / median_price, 6) AS price_ratio FROM g", VIEWS)
def price_for_100(t):
    base = X.area_incomes(X.parish_incomes(t("parish_income"))).join(X.area_medians(t("index_listings")), ["level", "area"], "left")
    g = X.scenario_table(base, P100).withColumn("p", F.col("median_income") / fin.qualifying_income(F.lit(1.0), F.col("rate"), F.col("deposit"), F.col("term"), F.col("cap")))
    return g.select("level", "area", "terms", F.round("p", 2).alias("price_oai_100"), F.round(F.col("p") / F.col("median_price"), 6).alias("price_ratio"))


@query("sigma_from_gini", f"SELECT parish, round({2**0.5!r}e0 * ({fin.phi_inverse_sql('((gini + 1) / 2)')}), 6) AS sigma, round({fin.phi_sql('((income - 500000) / 200000)')}, 6) AS phi FROM parish_income", VIEWS[1:])
def sigma_from_gini(t):
    return t("parish_income").select("parish", F.round(fin.sigma_from_gini(F.col("gini")), 6).alias("sigma"), F.round(fin.phi((F.col("income") - 500000) / 200000), 6).alias("phi"))


@query("income_inputs", BASE + " SELECT level, area, round(quantile_cont(income, 0.1), 4) AS p10, round(quantile_cont(income, 0.5), 4) AS p50, round(quantile_cont(income, 0.9), 4) AS p90, round(avg(sigma), 6) AS sigma, CAST(count(*) AS BIGINT) AS parishes FROM tinc GROUP BY 1, 2", VIEWS)
def income_inputs(t):
    p = F.percentile("income", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = X.tagged(X.parish_incomes(t("parish_income"))).groupBy("level", "area").agg(p.alias("p"), F.avg("sigma").alias("sigma"), F.count(F.lit(1)).alias("parishes"))
    return g.select("level", "area", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], F.round("sigma", 6).alias("sigma"), "parishes")

"""Queries over land, finance, duplicates, names, regressions and learning."""

from __future__ import annotations


from pyspark.sql import functions as F

from hearthframe.functions import finance as fin
from hearthframe.operators import duplicates as U
from hearthframe.operators import finance as N
from hearthframe.operators import models as M
from hearthframe.operators import relational as R

from .registry import query

RATES = {"shell": 900_000.0, "apartment": 1_700_000.0, "storeyed": 1_600_000.0, "bungalow_high": 1_500_000.0, "bungalow_standard": 1_200_000.0}
CLASS = "CASE WHEN did % 11 = 0 THEN 'shell' WHEN did % 4 = 0 THEN 'apartment' WHEN did % 5 = 0 THEN 'storeyed' WHEN f_pool + f_gated + f_furnished >= 2 THEN 'bungalow_high' ELSE 'bungalow_standard' END"
LAND = f", c AS (SELECT *, {CLASS} AS cost_class FROM dwelling), i AS (SELECT c.*, m AS metres, coalesce(floor_m2, greatest(bedrooms, 1) * m) AS floor_est, CASE cost_class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items()) + " END AS rate FROM c, (VALUES (25e0), (32e0), (40e0)) s(m)), il AS (SELECT *, price - floor_est * rate * 0.85e0 AS land_value FROM i), iv AS (SELECT *, land_value / price AS land_share, land_value / plot AS land_per_decimal, land_value <= 0 AS negative FROM il)"


def _implied(t):
    c = N.cost_class((F.col("did") % 11 == 0).cast("int"), F.when(F.col("did") % 4 == 0, "apartment").otherwise("house"), (F.col("did") % 5 == 0).cast("int"), [F.col("f_pool"), F.col("f_gated"), F.col("f_furnished")])
    return N.implied_land_value(t("dwelling").withColumn("cost_class", c), RATES)


@query("implied_land_value", LAND + " SELECT did, metres, cost_class, round(land_value, 2) AS land_value, round(land_share, 6) AS land_share, negative FROM iv", ("dwelling",))
def implied_land_value(t):
    return _implied(t).select("did", "metres", "cost_class", F.round("land_value", 2).alias("land_value"), F.round("land_share", 6).alias("land_share"), "negative")


@query("land_by_unit", LAND + ", g AS (SELECT unit, quantile_cont(land_share, 0.5) FILTER (WHERE NOT negative) AS s, quantile_cont(land_per_decimal, 0.5) FILTER (WHERE NOT negative) AS p, count(*) FILTER (WHERE NOT negative) AS n, avg(CAST(negative AS DOUBLE)) AS neg FROM iv GROUP BY 1) SELECT unit, round(CASE WHEN n >= 5 THEN s END, 6) AS median_land_share, round(CASE WHEN n >= 5 THEN p END, 2) AS median_land_per_decimal, CAST(n AS BIGINT) AS n_houses, round(neg, 6) AS share_negative FROM g", ("dwelling",))
def land_by_unit(t):
    return N.land_value_by_unit(_implied(t), "unit").select("unit", F.round("median_land_share", 6).alias("median_land_share"), F.round("median_land_per_decimal", 2).alias("median_land_per_decimal"), "n_houses", F.round("share_negative", 6).alias("share_negative"))


@query("land_validation", LAND + ", g AS (SELECT unit, quantile_cont(land_per_decimal, 0.5) FILTER (WHERE NOT negative) AS a, quantile_cont(price / plot, 0.5) AS b FROM iv GROUP BY 1), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM g WHERE a IS NOT NULL) SELECT round(corr(ra, rb), 6) AS spearman, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(a / b, 0.5), 6) AS median_ratio FROM r", ("dwelling",))
def land_validation(t):
    g = _implied(t).groupBy("unit").agg(F.percentile(F.when(~F.col("negative"), F.col("land_per_decimal")), 0.5).alias("a"), F.percentile(F.col("price") / F.col("plot"), 0.5).alias("b")).filter("a IS NOT NULL")
    ratio = g.agg(F.round(F.percentile(F.col("a") / F.col("b"), 0.5), 6).alias("median_ratio"))
    return R.spearman(g, "a", "b").select(F.round("spearman", 6).alias("spearman"), "n").join(ratio)


AREA = ", a AS (SELECT subcounty AS area, quantile_cont(rent_month / bedrooms, 0.5) AS rent_per_bed, count(rent_month) AS n_rent, quantile_cont(price / bedrooms, 0.5) AS price_per_bed, count(price) AS n_sale, quantile_cont(price, 0.5) AS price, quantile_cont(rent_month, 0.5) AS rent FROM index_listings GROUP BY 1)"


def _areas(t):
    return t("index_listings").groupBy(F.col("subcounty").alias("area")).agg(F.percentile(F.col("rent_month") / F.col("bedrooms"), 0.5).alias("rent_per_bed"), F.count("rent_month").alias("n_rent"), F.percentile(F.col("price") / F.col("bedrooms"), 0.5).alias("price_per_bed"), F.count("price").alias("n_sale"), F.percentile("price", 0.5).alias("price"), F.percentile("rent_month", 0.5).alias("rent"))


@query("yields", AREA + " SELECT area, round(12 * rent_per_bed / price_per_bed, 6) AS gross_yield, round(price_per_bed / (12 * rent_per_bed), 4) AS price_to_annual_rent FROM a WHERE n_rent >= 20 AND n_sale >= 20", ("index_listings",))
def yields(t):
    return N.yields(_areas(t)).select("area", F.round("gross_yield", 6).alias("gross_yield"), F.round("price_to_annual_rent", 4).alias("price_to_annual_rent"))


@query("plot_and_build", AREA + ", s AS (SELECT a.*, v AS saving_rate, 12 * v * rent * 3 AS yearly FROM a, (VALUES (0.1e0), (0.2e0), (0.3e0)) x(v)) SELECT area, saving_rate, round(45e6 / yearly, 6) AS years_shell, round(15e6 / yearly, 6) AS years_finish, round(0.3 * price / yearly, 6) AS years_deposit, round(price / 50 * (5000 / 435.6e0) / yearly, 6) AS years_plot_standard, round(price / 50 * (2500 / 435.6e0) / yearly, 6) AS years_plot_small FROM s", ("index_listings",))
def plot_and_build(t):
    a = _areas(t).withColumns({"income": F.col("rent") * 3, "land_per_decimal": F.col("price") / 50})
    return N.plot_and_build(a, 45e6, 15e6, 21.6e6).select("area", "saving_rate", *[F.round(c, 6).alias(c) for c in ("years_shell", "years_finish", "years_deposit", "years_plot_standard", "years_plot_small")])


QUOTES = "q AS (SELECT CAST(3 + s_suppkey AS DOUBLE) AS km, 1500 * pow(3 + s_suppkey, 0.48) * (1 + (s_suppkey % 7) / 100e0) AS fare FROM supplier)"


def _quotes(t):
    k = (3 + F.col("s_suppkey")).cast("double")
    return t("supplier").select(k.alias("km"), (1500 * F.pow(k, 0.48) * (1 + (F.col("s_suppkey") % 7) / 100)).alias("fare"))


@query("fare_model", f"WITH {QUOTES} SELECT round(exp(regr_intercept(ln(fare), ln(km))), 4) AS a, round(regr_slope(ln(fare), ln(km)), 6) AS b FROM q")
def fare_model(t):
    return N.fare_model(_quotes(t)).select(F.round("a", 4).alias("a"), F.round("b", 6).alias("b"))


@query("housing_transport", AREA + f", {QUOTES}, m AS (SELECT exp(regr_intercept(ln(fare), ln(km))) AS fa, regr_slope(ln(fare), ln(km)) AS fb FROM q), d AS (SELECT area, rent, c AS commuters, 44 * c * fa * pow(1.3e0 * length(area), fb) AS fares, 44 * c * (20e0 + length(area)) / 60 * (0.5e0 * 1000000 / 176) AS tm FROM a, m, (VALUES (1), (2)) x(c)) SELECT area, commuters, round(fares, 4) AS fares, round(rent / 1e6, 5) AS h_burden, round(fares / 1e6, 6) AS t_burden, round((rent + fares) / 1e6, 6) AS ht_burden, round((rent + fares + tm) / 1e6, 6) AS ht_generalised FROM d", ("index_listings",))
def housing_transport(t):
    a = _areas(t).withColumns({"km": 1.3 * F.length("area"), "minutes": 20.0 + F.length("area")})
    return N.housing_transport(a, N.fare_model(_quotes(t)), 1e6).select("area", "commuters", F.round("fares", 4).alias("fares"), F.round("h_burden", 5).alias("h_burden"), *[F.round(c, 6).alias(c) for c in ("t_burden", "ht_burden", "ht_generalised")])


VALUES = "v AS (SELECT 'lower quartile' AS basis, quantile_cont(price, 0.25) AS value FROM index_listings UNION ALL SELECT 'median', quantile_cont(price, 0.5) FROM index_listings)"


def _values(t):
    p = t("index_listings").agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.5))).alias("p"))
    return p.select(F.inline(F.array(F.struct(F.lit("lower quartile").alias("basis"), F.col("p")[0].alias("value")), F.struct(F.lit("median").alias("basis"), F.col("p")[1].alias("value")))))


@query("value_capture", f", {VALUES} SELECT basis, beta, share, round(value * (1 - exp(-beta)), 2) AS uplift, round(167599 * share * value * (1 - exp(-beta)), 0) AS total, round(167599 * share * value * (1 - exp(-beta)) / 48e9, 6) AS toll_years FROM v, (VALUES (0.19e0), (0.212e0), (0.259e0)) b(beta), (VALUES (0.1e0), (0.25e0), (0.5e0)) s(share)", ("index_listings",))
def value_capture(t):
    return N.value_capture(_values(t), 167599.0).select("basis", "beta", "share", F.round("uplift", 2).alias("uplift"), F.round("total", 0).alias("total"), F.round("toll_years", 6).alias("toll_years"))


@query("affordability_premium", f", {VALUES}, p AS (SELECT basis, beta, value, value * (1 - exp(-beta)) AS premium FROM v, (VALUES (0.19e0), (0.212e0), (0.259e0)) b(beta)) SELECT basis, beta, round(premium, 2) AS premium, round({fin.payment_sql('value * 0.7e0', '0.18293e0', '20')} / 0.35e0, 2) AS needed_with, round({fin.payment_sql('(value - premium) * 0.7e0', '0.18293e0', '20')} / 0.35e0, 2) AS needed_without FROM p", ("index_listings",))
def affordability_premium(t):
    return N.affordability_premium(_values(t)).select("basis", "beta", *[F.round(c, 2).alias(c) for c in ("premium", "needed_with", "needed_without")])


@query("key_workers", AREA + " SELECT p_type AS occupation, e AS earners, area AS bar, round(earnings * e / (rent / 0.3e0), 6) AS ratio FROM (SELECT p_type, avg(p_retailprice) * 300 AS earnings FROM part GROUP BY 1), (VALUES (1), (2)) x(e), a", ("index_listings",))
def key_workers(t):
    w = t("part").groupBy(F.col("p_type").alias("occupation")).agg((F.avg("p_retailprice") * 300).alias("earnings"))
    bars = _areas(t).select(F.col("area").alias("bar"), (F.col("rent") / 0.3).alias("needed"))
    return N.worker_ratios(w, bars).select("occupation", "earners", "bar", F.round("ratio", 6).alias("ratio"))


@query("affordable_supply", "SELECT coalesce(subcounty, 'TOTAL') AS area, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 20 THEN avg(CAST(rent_month <= 150000 AS DOUBLE)) END, 6) AS share FROM index_listings WHERE listing_type = 'rent' GROUP BY GROUPING SETS ((subcounty), ())", ("index_listings",))
def affordable_supply(t):
    g = t("index_listings").filter("listing_type = 'rent'").groupingSets([[F.col("subcounty")], []], F.col("subcounty")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rent_month") <= 150000).cast("double")).alias("s"))
    return g.select(F.coalesce("subcounty", F.lit("TOTAL")).alias("area"), "n", F.round(F.when(F.col("n") >= 20, F.col("s")), 6).alias("share"))


def _dup(t):
    """Documents as postings, whose candidate pairs are those of one language and nearly one length."""
    text = F.coalesce("text", F.lit(""))
    return t("documents").select(F.col("doc_id").alias("rid"), "source", "lang", F.col("n_chars").cast("double").alias("price"), U.comparison_text(F.col("text"), F.col("source")).alias("txt"), F.col("source").alias("agent"), F.length(F.substring(text, 1, 400)).alias("filled")).withColumn("words", U.sorted_words("txt"))


def _dup_classes(t):
    """The documents with the classes that all links make, by a forest of the links: copies are not paired, and a pair of texts is compared once."""
    rows = _dup(t)
    return rows, U.clusters(rows, U.ties(rows, ["lang"]))


@query("dedup_edges")
def dedup_edges(t):
    return U.links(_dup(t), ["lang"])


@query("dup_components")
def dup_components(t):
    return _dup_classes(t)[1]


@query("dedup_representatives")
def dedup_representatives(t):
    rows, classes = _dup_classes(t)
    j = rows.join(classes, "rid")
    return U.representatives(j, "cluster", F.col("filled"), "price").select("rid", "cluster", "n_postings", F.col("n_portals").cast("bigint").alias("n_portals"))


@query("dedup_similarity")
def dedup_similarity(t):
    rows = t("documents").select(F.col("doc_id").alias("rid"), "lang", "source", F.col("n_chars").cast("double").alias("price"), U.comparison_text(F.col("text"), F.col("source")).alias("txt"), F.col("source").alias("agent"))
    return U.links(rows.withColumn("words", U.sorted_words("txt")), ["lang"])


@query(
    "gazetteer_match",
    "WITH g AS (SELECT n_nationkey AS ord, n_name AS place, lower(replace(n_name, '_', ' ')) AS plain FROM nation), n AS (SELECT ord, place, trim(regexp_replace(regexp_replace(lower(place), '[^a-z]', ' ', 'g'), ' +', ' ', 'g')) AS nm FROM g WHERE ord = 3), t AS (SELECT c_custkey AS tid, CASE c_custkey % 3 WHEN 0 THEN 'Nation' WHEN 1 THEN 'near nation road' ELSE 'elsewhere' END AS x FROM customer) SELECT tid, CASE tid % 3 WHEN 2 THEN NULL ELSE 'NATION_24' END AS place, CASE tid % 3 WHEN 0 THEN 'lookup_exact' WHEN 1 THEN 'lookup_contains' END AS method FROM t",
)
def gazetteer_match(t):
    # Digits are no part of a name, so every nation is called "nation" here: the last exact row wins.
    g = t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("place"), F.col("n_name").alias("name"))
    x = t("customer").select(F.col("c_custkey").alias("tid"), F.when(F.col("c_custkey") % 3 == 0, "Nation").when(F.col("c_custkey") % 3 == 1, "near nation road").otherwise("elsewhere").alias("text"))
    return U.match_place(x, g, "text", "tid")


@query("parish_match", "SELECT c_custkey AS tid, r_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0")
def parish_match(t):
    r = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = t("customer").join(r, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("tid"), F.lit("North").alias("district"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("xy, "), "r_name", F.lit(" Ward"))).otherwise("nowhere").alias("text"))
    areas = t("region").select(F.col("r_name").alias("area"), F.lit("north").alias("district")).unionByName(t("region").select(F.concat("r_name", F.lit(" II")).alias("area"), F.lit("south").alias("district")))
    return U.match_area(x, areas, "tid")


@query("fuzzy_match")
def fuzzy_match(t):
    x = t("customer").select(F.col("c_custkey").alias("tid"), F.col("c_nationkey").alias("b"), F.concat(F.col("c_mktsegment"), F.lit(" vilage")).alias("text"))
    names = t("customer").select(F.col("c_nationkey").alias("b"), F.concat(F.initcap("c_mktsegment"), F.lit(" Village")).alias("name")).distinct()
    return U.match_fuzzy(x, names, "b", "tid").withColumn("ratio", F.round("ratio", 4))


@query("did_2x2", "SELECT round((avg(y) FILTER (WHERE post = 1 AND treated = 1) - avg(y) FILTER (WHERE post = 0 AND treated = 1)) - (avg(y) FILTER (WHERE post = 1 AND treated = 0) - avg(y) FILTER (WHERE post = 0 AND treated = 0)), 6) AS did, CAST(count(*) AS BIGINT) AS n FROM panel", ("panel",))
def did_2x2(t):
    return M.did_2x2(t("panel")).select(F.round("did", 6).alias("did"), "n")


def _rows(t, rows: list[dict]):
    return t("region").sparkSession.createDataFrame(rows)


@query("did_cluster")
def did_cluster(t):
    return _rows(t, [M.did_cluster(t("panel"))])


@query("did_trimmed", ", q AS (SELECT post, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM panel GROUP BY 1) SELECT post, treated, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean FROM panel JOIN q USING (post) WHERE y BETWEEN lo AND hi GROUP BY 1, 2", ("panel",))
def did_trimmed(t):
    q = t("panel").groupBy("post").agg(F.percentile("y", 0.05).alias("lo"), F.percentile("y", 0.95).alias("hi"))
    return t("panel").join(q, "post").filter(F.col("y").between(F.col("lo"), F.col("hi"))).groupBy("post", "treated").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query("ols_cluster")
def ols_cluster(t):
    d = t("panel").withColumns({"one": F.lit(1.0), "x": (F.col("post") * F.col("treated")).cast("double"), "p": F.col("post").cast("double"), "tr": F.col("treated").cast("double")})
    return _rows(t, M.ols_cluster(d, "y", ["one", "p", "tr", "x", "z"], "point"))


@query("hedonic_premium")
def hedonic_premium(t):
    d = t("dwelling").withColumns({"one": F.lit(1.0), "lp": F.ln("price"), "b": F.col("bedrooms").cast("double"), "pool": F.col("f_pool").cast("double"), "lplot": F.ln("plot")})
    return _rows(t, [M.premium(M.ols_cluster(d, "lp", ["one", "b", "lplot", "pool"], "unit"), "pool")])


@query("bootstrap_ci")
def bootstrap_ci(t):
    return M.bootstrap_median(t("listing_raw"), "nation", "amount0")


@query("precision_curve")
def precision_curve(t):
    return M.precision_curve(t("listing_raw"), "region_id", "amount0")


@query("convergence", ", r AS (SELECT lid, amount0, s FROM listing_raw, (VALUES (50), (75), (100)) x(s) WHERE ((lid * 7919) % 100 + 100) % 100 < s) SELECT s AS percent, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(amount0, 0.5), 4) AS median FROM r GROUP BY 1", ("listing_raw",))
def convergence(t):
    r = t("listing_raw").withColumn("percent", F.explode(F.array(F.lit(50), F.lit(75), F.lit(100)))).filter(F.pmod(F.col("lid") * 7919, F.lit(100)) < F.col("percent"))
    return r.groupBy("percent").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("amount0", 0.5), 4).alias("median"))


@query("robustness_variants", ", v AS (SELECT * FROM (VALUES ('without alpha', 'alpha'), ('without beta', 'beta'), ('without gamma', 'gamma'), ('all', ''), ('with a listing date', '-')) x(variant, dropped)) SELECT variant, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(amount0, 0.5), 4) AS median FROM listing_raw, v WHERE CASE WHEN dropped = '-' THEN listing_date IS NOT NULL ELSE source <> dropped END GROUP BY 1", ("listing_raw",))
def robustness_variants(t):
    rules = {f"without {s}": F.col("source") != s for s in ("alpha", "beta", "gamma")} | {"all": F.lit(True), "with a listing date": F.col("listing_date").isNotNull()}
    return M.variants(t("listing_raw").select("source", "listing_date", "amount0"), rules).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("amount0", 0.5), 4).alias("median"))


def _scores(t):
    e = t("embeddings").select("vec_id", (F.col("vec_id") % 5).alias("fold"), "label", F.col("embedding")[0].cast("double").alias("y"), (F.col("embedding")[0] * 0.8 + F.col("embedding")[1] * 0.2).cast("double").alias("yhat"))
    return e


@query("cv_metrics", "WITH e AS (SELECT vec_id % 5 AS fold, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) * 0.8e0 + CAST(embedding[2] AS DOUBLE) * 0.2e0 AS yhat FROM embeddings) SELECT fold, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 5) AS rmse, round(avg(abs(y - yhat)), 5) AS mae, round(1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y)), 5) AS r2 FROM e GROUP BY 1")
def cv_metrics(t):
    e = t("embeddings").select((F.col("vec_id") % 5).alias("fold"), F.col("embedding")[0].cast("double").alias("y"), (F.col("embedding")[0].cast("double") * 0.8 + F.col("embedding")[1].cast("double") * 0.2).alias("yhat"))
    return M.cv_metrics(e, ["fold"], "y", "yhat").select("fold", "n", *[F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2")])


@query("shap_summary", "WITH l AS (SELECT 'a' AS column_, abs(CAST(embedding[1] AS DOUBLE)) AS v FROM embeddings UNION ALL SELECT 'k__x', abs(CAST(embedding[2] AS DOUBLE)) FROM embeddings UNION ALL SELECT 'k__y', abs(CAST(embedding[3] AS DOUBLE)) FROM embeddings), m AS (SELECT column_, avg(v) AS v FROM l GROUP BY 1) SELECT regexp_replace(column_, '__.*$', '') AS feature, round(sum(v), 6) AS importance FROM m GROUP BY 1")
def shap_summary(t):
    s = t("embeddings").select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("a", "k__x", "k__y"))])
    return M.shap_importance(s, ["a", "k__x", "k__y"]).withColumn("importance", F.round("importance", 6))


@query("shap_by_unit", "WITH l AS (SELECT label, 'a' AS c, abs(CAST(embedding[1] AS DOUBLE)) AS v FROM embeddings UNION ALL SELECT label, 'b', abs(CAST(embedding[2] AS DOUBLE)) FROM embeddings UNION ALL SELECT label, 'c', abs(CAST(embedding[3] AS DOUBLE)) FROM embeddings), m AS (SELECT label, c, avg(v) AS v FROM l GROUP BY 1, 2) SELECT label AS unit, max_by(c, v) AS dominant, round(max(v) / sum(v), 6) AS share FROM m GROUP BY 1")
def shap_by_unit(t):
    s = t("embeddings").select(F.col("label").alias("unit"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])
    return M.shap_by_unit(s, "unit", ["a", "b", "c"]).withColumn("share", F.round("share", 6))


@query("rf_cv")
def rf_cv(t):
    p = t("points").withColumns({"block": F.concat_ws("_", F.floor(F.col("x") / 3000).cast("string"), F.floor(F.col("y") / 3000).cast("string")), "ly": F.ln("value")})
    return M.cv_metrics(M.forest_cv(M.block_folds(p, "block", 5), ["x", "y"], "ly", "fold", 10), ["fold"], "ly", "prediction")


@query("gbt_cv")
def gbt_cv(t):
    p = t("points").withColumns({"block": F.concat_ws("_", F.floor(F.col("x") / 5000).cast("string"), F.lit("0")), "ly": F.ln("value")})
    return M.cv_metrics(M.forest_cv(M.block_folds(p, "block", 2), ["x", "y"], "ly", "fold", 5, boosted=True), ["fold"], "ly", "prediction")


@query("gwr")
def gwr(t):
    p = t("points").select(F.col("pid").alias("rid"), "x", "y", F.ln("value").alias("ly"), (F.col("pid") % 7).cast("double").alias("z"))
    return M.gwr(p.sparkSession, p, "ly", ["z"], 100)


@query("moran_permutation")
def moran_permutation(t):
    from . import spatial as P

    return _rows(t, [M.moran_permutation(P._values(t), P.S.knn_weights(P._areas(t), 6))])


@query("wealth_pc1")
def wealth_pc1(t):
    d = t("parish_income").withColumns({f"s{i}": F.sin(F.col("income") / 1e5 * (i + 1)) + F.col("gini") for i in range(6)})
    out, _ = M.wealth_index(d, [f"s{i}" for i in range(6)], ("s5",))
    return out.select("parish", F.round("wealth", 8).alias("wealth"))


@query("income_model", ", p AS (SELECT parish, region_id AS region, households, ln(income) - 12 AS wealth, 400000e0 + 60000 * region_id AS median FROM parish_income WHERE income > 0), r AS (SELECT region, sum(households * wealth) / sum(households) AS wm, max(median) AS median FROM p GROUP BY 1), b AS (SELECT regr_slope(ln(median), wm) AS b FROM r) SELECT parish, round(r.median * exp(b * (wealth - wm)), 3) AS modelled FROM p JOIN r USING (region), b", ("parish_income",))
def income_model(t):
    p = t("parish_income").filter("income > 0").select("parish", F.col("region_id").alias("region"), "households", (F.ln("income") - 12).alias("wealth"), (400000.0 + 60000 * F.col("region_id")).alias("median"))
    return M.income_model(p).select("parish", F.round("modelled", 3).alias("modelled"))


@query("time_dummy_index")
def time_dummy_index(t):
    p = t("index_listings").filter("listing_type = 'rent'").withColumns({"lr": F.ln("rent_month"), "q": F.concat(F.year("listing_date").cast("string"), F.lit("Q"), F.quarter("listing_date").cast("string"))})
    return _rows(t, M.time_dummy_index(p, "lr", "q", ["bedrooms"]))


@query("premium_table")
def premium_table(t):
    d = t("dwelling").withColumns({"lp": F.ln("price"), "b": F.col("bedrooms").cast("double"), "lplot": F.ln("plot")})
    return _rows(t, M.premium_table(d, "lp", "kind", ["b", "lplot"], "unit"))


@query("matched_yield")
def matched_yield(t):
    d = t("index_listings").withColumns({"v": F.ln(F.coalesce("rent_month", "price")), "r": (F.col("listing_type") == "rent").cast("int")})
    return _rows(t, M.matched_yield(d, "v", "r", "district", ["bedrooms"], {"bedrooms": 2.0}))


@query("linear_baseline")
def linear_baseline(t):
    d = t("dwelling").withColumns({"lp": F.ln("price"), "b": F.col("bedrooms").cast("double")})
    return M.cv_metrics(M.linear_baseline(d.filter("did % 5 <> 0"), d.filter("did % 5 = 0"), ["b", "plot", "floor_m2"], "lp").withColumn("fold", F.lit(0)), ["fold"], "lp", "prediction")


@query("dedup_listings")
def dedup_listings(t):
    """Classes of listings that are one posting: by portal id, or by market, type, bedrooms, place, price and text."""
    l = t("listing_raw")  # noqa: E741
    rows = l.select(
        F.col("lid").alias("rid"), "source", "source_id", F.col("listing_type").alias("market"), F.col("property_type").alias("ptype"), F.col("bedrooms_raw").alias("bedrooms"), F.lower("location_raw").alias("place"),
        F.col("amount0").alias("price"), "agent", U.comparison_text(F.col("description"), F.col("title")).alias("txt"),
    )
    return U.listing_clusters(rows)


@query("lisa_permutation")
def lisa_permutation(t):
    from . import spatial as P

    return P.S.local_permutation(P._values(t), P.S.knn_weights(P._areas(t), 6))


@query("feature_matrix", ", f AS (SELECT * FROM dwelling) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(bedrooms AS DOUBLE)), 6) AS bedrooms, round(avg(floor_m2), 6) AS floor_m2, round(avg(CAST(kind = (SELECT min(kind) FROM dwelling) AS DOUBLE)), 6) AS first_kind FROM f", ("dwelling",))
def feature_matrix(t):
    d, names = M.feature_matrix(t("dwelling"), ["bedrooms", "floor_m2", "absent"], ["kind"], xy=None)
    first = next(n for n in names if n.startswith("kind__"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bedrooms"), 6).alias("bedrooms"), F.round(F.avg("floor_m2"), 6).alias("floor_m2"), F.round(F.avg(f"`{first}`"), 6).alias("first_kind"))


@query("price_regression")
def price_regression(t):
    d = t("dwelling").withColumns({"listing_type": F.lit("sale"), "lp": F.ln("price"), "plot_decimals": F.col("plot")})
    made, names = M.price_design(d, "sale", ["f_pool", "f_gated"], [], {"kind": None})
    return _rows(t, M.ols_cluster(made, "lp", names, "unit"))

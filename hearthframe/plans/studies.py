"""Queries over study designs, explanations, outlines, name tiers and summary tables of the finance and access studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import finance as fin
from hearthframe.operators import duplicates as U
from hearthframe.operators import explain as E
from hearthframe.operators import finance as N
from hearthframe.operators import index as X
from hearthframe.operators import models as M
from hearthframe.operators import relational as R
from hearthframe.operators import spatial as S
from hearthframe.sources import records as C

from . import index as PI
from . import models as PM
from . import relational as PR
from . import spatial as PS
from .registry import query

# ---- Outlines, classes, weights, catchments. ----
EDGES = ", e AS (SELECT region_id AS unit, unnest([{'ax': x0, 'ay': y0, 'bx': x1, 'by': y0}, {'ax': x0, 'ay': y1, 'bx': x1, 'by': y1}, {'ax': x0, 'ay': y0, 'bx': x0, 'by': y1}, {'ax': x1, 'ay': y0, 'bx': x1, 'by': y1}], recursive := true) FROM units)"


@query("dissolved_outline", EDGES + " SELECT unit, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(\"by\" AS DOUBLE) AS \"by\" FROM e GROUP BY ALL HAVING count(*) = 1", ("units",))
def dissolved_outline(t):
    return S.dissolve(t("units").select(F.col("region_id").alias("unit"), PS.ring("x0", "y0", "x1", "y1").alias("ring")), "unit")


@query("class_breaks_equal", ", m AS (SELECT min(value) AS lo, max(value) AS hi FROM points), e AS (SELECT [lo + (hi - lo) * 0.2e0, lo + (hi - lo) * 0.4e0, lo + (hi - lo) * 0.6e0, lo + (hi - lo) * 0.8e0] AS q FROM m) SELECT pid, CAST(len(list_filter(q, lambda x: x < value)) AS INTEGER) AS class FROM points, e", ("points",))
def class_breaks_equal(t):
    return S.class_breaks(t("points"), "value", 5, "equal_interval").select("pid", "class")


@query("class_breaks_symmetric", ", d AS (SELECT pid, value - 150000 AS v FROM points), s AS (SELECT quantile_cont(abs(v), 0.97) / 3 AS s FROM d) SELECT pid, CAST(len(list_filter([-2 * s, -s, 0, s, 2 * s], lambda x: x < v)) AS INTEGER) AS class FROM d, s", ("points",))
def class_breaks_symmetric(t):
    return S.class_breaks(t("points").select("pid", (F.col("value") - 150000).alias("v")), "v", 6, "symmetric").select("pid", "class")


@query("class_breaks_natural")
def class_breaks_natural(t):
    return S.class_breaks(t("points"), "value", 5, "fisher_jenks").select("pid", "class")


@query("contiguity_weights", "SELECT a.unit AS i, b.unit AS j, round(1e0 / count(*) OVER (PARTITION BY a.unit), 6) AS w FROM units a JOIN units b ON a.unit <> b.unit AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1", ("units",))
def contiguity_weights(t):
    return S.contiguity_weights(t("units").withColumnRenamed("unit", "id")).select("i", "j", F.round("w", 6).alias("w"))


@query("catchment", PS.TIMES + " SELECT node, minutes FROM times WHERE minutes <= 15", ("road_edges",))
def catchment(t):
    return PS._times(t).filter("minutes <= 15")


# ---- Names. ----
@query("gazetteer_fuzzy")
def gazetteer_fuzzy(t):
    names = t("part").select(F.lower("p_type").alias("name")).distinct().select(F.xxhash64("name").alias("ord"), F.col("name").alias("place"), "name")
    x = t("part").select(F.col("p_partkey").alias("tid"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lower("p_type"), F.lit("e village"))).otherwise(F.concat(F.lit("off the "), F.reverse("p_type"))).alias("text"))
    return U.match_place_fuzzy(x, names, "text", "tid")


@query("pool_match")
def pool_match(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = c.select(F.col("c_custkey").alias("tid"), F.col("r_name").alias("district"), F.concat(F.lit("sub "), F.translate("n_name", "_0123456789", " abcdefghij")).alias("subcounty"), F.concat("c_mktsegment", F.lit("e")).alias("parish"))
    names = c.select(F.col("r_name").alias("district"), F.concat(F.lit("sub "), F.translate("n_name", "_0123456789", " abcdefghij")).alias("subcounty"), F.col("c_mktsegment").alias("parish")).distinct().withColumn("nid", F.concat_ws("/", "district", "subcounty", "parish"))
    return U.match_in_pool(x, names, "tid").withColumn("ratio", F.round("ratio", 4))


@query("parish_points", "SELECT c_custkey AS tid, r_name AS area, CASE WHEN r_regionkey = 2 THEN round(1.01e0, 6) ELSE CAST(r_regionkey AS DOUBLE) END AS lat, CAST(32 AS DOUBLE) AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0 AND r_regionkey <> 3")
def parish_points(t):
    r = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = t("customer").join(r, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("tid"), F.lit("West").alias("district"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("xy, "), "r_name")).otherwise("nowhere").alias("text"))
    at = t("region").withColumn("lat", F.when(F.col("r_regionkey") == 2, 1.0).otherwise(F.col("r_regionkey").cast("double"))).select(F.col("r_name").alias("area"), F.lit("north").alias("district"), "lat", F.lit(32.0).alias("lon"), "r_regionkey")
    more = at.filter("r_regionkey IN (2, 3)").select("area", F.lit("south").alias("district"), (F.col("lat") + F.when(F.col("r_regionkey") == 2, 0.02).otherwise(1.0)).alias("lat"), "lon")
    return U.match_area_point(x, at.drop("r_regionkey").unionByName(more), "tid").withColumn("lat", F.round("lat", 6))


# ---- Study designs. ----
DID = """, m AS (SELECT point, avg(CAST(post * treated AS DOUBLE)) AS mx, avg(CAST(post AS DOUBLE)) AS mp, avg(y) AS my FROM panel GROUP BY 1),
  d AS (SELECT point, post * treated - mx AS x, post - mp AS p, y - my AS y FROM panel JOIN m USING (point)),
  g AS (SELECT point, sum(x * x) AS xx, sum(x * p) AS xp, sum(p * p) AS pp, sum(x * y) AS xy, sum(p * y) AS py, count(*) AS n FROM d GROUP BY 1),
  t AS (SELECT sum(xx) AS txx, sum(xp) AS txp, sum(pp) AS tpp, sum(xy) AS txy, sum(py) AS tpy, sum(n) AS n, count(*) AS k, txx * tpp - txp * txp AS det FROM g),
  b AS (SELECT *, (tpp * txy - txp * tpy) / det AS b, (txx * tpy - txp * txy) / det AS c FROM t),
  s AS (SELECT sum(pow((tpp * (xy - b * xx - c * xp) - txp * (py - b * xp - c * pp)) / det, 2)) AS v FROM g, b)
  SELECT round(b, 7) AS coef, round(sqrt(v * k / (k - 1) * (n - 1) / (n - 2 - k)), 7) AS se, CAST(n AS BIGINT) AS n, k AS points FROM b, s"""


@query("did_errors", DID, ("panel",))
def did_errors(t):
    return PM._rows(t, M.did_fit(t("panel"), ["treated"], 0)).select(F.round("coef", 7).alias("coef"), F.round("se", 7).alias("se"), "n", "points")


@query("did_checks")
def did_checks(t):
    d = t("panel").withColumns({"minutes": (F.col("point") * 7 % 40).cast("double"), "other": (F.col("point") * 11 % 40).cast("double")})
    return PM._rows(t, M.did_checks(d, "minutes", placebos=("other",), subsets={"small z": F.col("z") <= 3}))


@query("specifications")
def specifications(t):
    d = t("panel").withColumns({"minutes": F.log1p((F.col("point") * 7 % 40).cast("double")), "distance": F.log1p((F.col("point") * 3 % 25).cast("double")), "wealth": F.sin("point"), "p": F.col("post").cast("double")})
    return PM._rows(t, M.specifications(d, "y", {"distance": ["distance"], "time": ["minutes"], "both": ["minutes", "distance"]}, ["z", "p"], "point", ("wealth",)))


def _corridor(t):
    """The panel with the sector and the band of travel time of its points, and two further lines to be near to."""
    d = t("panel").withColumns({"minutes": F.log1p((F.col("point") * 7 % 40).cast("double")), "wealth": F.sin("point"), "p": F.col("post").cast("double")})
    return d.withColumns({"sector": F.col("point") % 8, "band": F.floor(F.col("point") * 7 % 40 / 8), "to_road": F.log1p((F.col("row_id") % 90).cast("double")), "to_rail": F.log1p((F.col("row_id") * 7 % 64).cast("double"))})


@query("fixed_effects")
def fixed_effects(t):
    specs = {"plain": ["to_road"], "sectors": ["to_road"], "sectors and bands": ["to_road"]}
    return PM._rows(t, M.specifications(_corridor(t), "y", specs, ["z", "p"], "point", effects={"sectors": ["sector"], "sectors and bands": ["sector", "band"]}))


# One effect is demeaned by SQL alike; the coefficient is that of the demeaned columns.
@query(
    "sector_effects",
    ", d AS (SELECT y - avg(y) OVER s AS y, x - avg(x) OVER s AS x FROM (SELECT y, ln(1 + row_id % 90) AS x, point % 8 AS sector FROM panel) WINDOW s AS (PARTITION BY sector)) SELECT round(sum(x * y) / sum(x * x), 8) AS coef, CAST(count(*) AS BIGINT) AS n FROM d",
    ("panel",),
)
def sector_effects(t):
    d, _ = M.within(_corridor(t), ["y", "to_road"], ["sector"])
    return d.agg(F.round(F.sum(F.col("to_road") * F.col("y")) / F.sum(F.col("to_road") * F.col("to_road")), 8).alias("coef"), F.count(F.lit(1)).alias("n"))


@query("placebo_lines")
def placebo_lines(t):
    return PM._rows(t, M.placebo_lines(_corridor(t), "y", "to_road", ["to_rail", "minutes"], ["wealth", "z"], "point"))


def _spots(t):
    return t("poi").select(F.col("poi").alias("rid"), F.col("px").alias("x"), F.col("py").alias("y"), (F.col("poi") % 7).cast("double").alias("z"), (F.sin(F.col("px") / 2000) + 0.2 * (F.col("poi") % 7) + (F.col("poi") % 13) / 50).alias("v"))


@query("gwr_bandwidth")
def gwr_bandwidth(t):
    d = _spots(t)
    return PM._rows(t, M.gwr_bandwidth(d.sparkSession, d, "v", ["z"], 8, 24))


@query("gwr_tests")
def gwr_tests(t):
    d = _spots(t)
    return M.gwr_tests(M.gwr(d.sparkSession, d, "v", ["z"], 20), 2)


@query("cv_schemes")
def cv_schemes(t):
    d = _spots(t).withColumn("block", F.concat_ws("_", F.floor(F.col("x") / 3000).cast("string"), F.floor(F.col("y") / 3000).cast("string")))
    return M.cv_schemes(d, ["x", "y", "z"], "v", "rid", "block", 3, 5, 12)


@query("tree_shap")
def tree_shap(t):
    d = t("dwelling").select("did", F.ln("price").alias("lp"), F.col("bedrooms").cast("double").alias("bedrooms"), "plot", "floor_m2", F.col("f_pool").cast("double").alias("f_pool"))
    return E.explained(d, ["bedrooms", "plot", "floor_m2", "f_pool"], "lp", 5).drop("lp")


# ---- Finance and access. ----
PREMIUMS = f", {PM.VALUES}, p AS (SELECT basis, beta, value * (1 - exp(-beta)) AS premium, {fin.payment_sql('value * 0.7e0', '0.18293e0', '20')} / 0.35e0 AS nw, {fin.payment_sql('value * exp(-beta) * 0.7e0', '0.18293e0', '20')} / 0.35e0 AS no FROM v, (VALUES (0.19e0), (0.212e0), (0.259e0)) b(beta))"
ABLE = f" SELECT basis, beta, round(1 - {PI.share('nw')}, 6) AS able_with, round(1 - {PI.share('no')}, 6) AS able_without, round(max(premium) / (12 * exp(sum(i.households * ln(i.income)) / sum(i.households))), 6) AS premium_years FROM p, inc i GROUP BY 1, 2"


@query("able_shares", PI.BASE + PREMIUMS + ABLE, PI.VIEWS)
def able_shares(t):
    p = N.affordability_premium(PM._values(t))
    return N.able_shares(p, t("parish_income"), ["basis", "beta"]).select("basis", "beta", *[F.round(c, 6).alias(c) for c in ("able_with", "able_without", "premium_years")])


@query("yield_benchmarks", PM.AREA + f", {PR.Q}, g AS (SELECT pow(max_by(v, q) / min_by(v, q), 1 / (date_diff('day', min(q), max(q)) / 365.25e0)) - 1 AS cagr FROM quarterly), y AS (SELECT quantile_cont(12 * rent_per_bed / price_per_bed, 0.5) AS median_yield, 12 * quantile_cont(rent_per_bed, 0.5) / quantile_cont(price_per_bed, 0.5) AS pooled_yield FROM a WHERE n_rent >= 20 AND n_sale >= 20) SELECT round(cagr, 6) AS cagr, round(median_yield, 6) AS median_yield, round(pooled_yield, 6) AS pooled_yield, round(pooled_yield + cagr, 6) AS total_return FROM g, y", ("index_listings", "monthly"))
def yield_benchmarks(t):
    q = t("monthly").groupBy(F.trunc("month", "quarter").alias("q")).agg(F.avg("value").alias("v"))
    return N.yield_benchmarks(PM._areas(t), R.growth(q, "q", "v", 4)).select(*[F.round(c, 6).alias(c) for c in ("cagr", "median_yield", "pooled_yield", "total_return")])


@query("visibility", ", h AS (SELECT district, sum(households) AS households FROM parish_income GROUP BY 1), n AS (SELECT district, CAST(count(*) AS BIGINT) AS listings, CAST(count(*) FILTER (WHERE listing_type = 'rent') AS BIGINT) AS rentals FROM index_listings GROUP BY 1), d AS (SELECT h.*, listings, rentals, households * (2 + r_regionkey) / 10 AS renting FROM h JOIN n USING (district) JOIN region ON r_name = district) SELECT district, listings, rentals, round(1000 * listings / households, 6) AS per_1000_hh, round(1000 * rentals / households, 6) AS rent_per_1000_hh, round(renting, 4) AS renting_households, round(renting * 0.4e0, 4) AS single_room_renters, round(renting / rentals, 6) AS renters_per_listing FROM d", PI.VIEWS)
def visibility(t):
    tenure = t("region").select(F.col("r_name").alias("district"), ((2 + F.col("r_regionkey")) / 10).alias("share_rented"), F.lit(0.4).alias("share_one_room"))
    v = N.visibility(t("index_listings"), t("parish_income"), tenure, "district")
    return v.select("district", "listings", "rentals", *[F.round(c, 6).alias(c) for c in ("per_1000_hh", "rent_per_1000_hh", "renters_per_listing")], *[F.round(c, 4).alias(c) for c in ("renting_households", "single_room_renters")])


SUPPLY = ", r AS (SELECT subcounty, rent_month, bedrooms, lid % 80 AS m, CASE WHEN lid % 80 > 0 THEN CASE WHEN lid % 80 <= 20 THEN '<20' WHEN lid % 80 <= 30 THEN '20-30' WHEN lid % 80 <= 45 THEN '30-45' WHEN lid % 80 <= 60 THEN '45-60' ELSE '60+' END END AS band, 100000 + 1000 * length(subcounty) AS own FROM index_listings WHERE listing_type = 'rent')"


@query("supply_by_group", SUPPLY + " SELECT kind, name, CAST(n AS BIGINT) AS n, round(wb, 6) AS within_budget, round(CASE WHEN kind = 'area' THEN wl ELSE wb END, 6) AS within_local, round(sr, 6) AS single_rooms FROM (SELECT CASE GROUPING(subcounty, band) WHEN 1 THEN 'area' WHEN 2 THEN 'time' ELSE 'all' END AS kind, coalesce(subcounty, band) AS name, count(*) AS n, avg(CAST(rent_month <= 150000 AS DOUBLE)) AS wb, avg(CAST(rent_month <= own AS DOUBLE)) AS wl, avg(CAST(bedrooms <= 1 AS DOUBLE)) AS sr FROM r GROUP BY GROUPING SETS ((subcounty), (band), ())) WHERE n >= 20 AND (kind = 'all' OR name IS NOT NULL)", ("index_listings",))
def supply_by_group(t):
    r = t("index_listings").filter("listing_type = 'rent'").withColumn("m", F.col("lid") % 80)
    local = t("nation").select(F.col("n_name").alias("subcounty"), (100000.0 + 1000 * F.length("n_name")).alias("local_budget"))
    return N.supply_by_group(r, "subcounty", "m", 150000.0, local).select("kind", "name", "n", *[F.round(c, 6).alias(c) for c in ("within_budget", "within_local", "single_rooms")])


PARISH = PI.FULL.replace("district || '/' || subcounty FROM inc)", "district || '/' || subcounty FROM inc UNION ALL SELECT *, 'parish', district || '/' || parish FROM inc)").replace("district || '/' || subcounty FROM il)", "district || '/' || subcounty FROM il UNION ALL SELECT *, 'parish', district || '/' || parish FROM il)").replace("il AS (SELECT district, subcounty,", "il AS (SELECT district, subcounty, parish,").replace(">= 20", ">= 3")


@query("affordability_index_parish", PARISH + f" SELECT area, n_rent, n_sale, {PI._r(PI.INDEX_VALUES, 4)} FROM ix WHERE level = 'parish'", PI.VIEWS)
def affordability_index_parish(t):
    return PI.rounded(X.area_index(t("index_listings"), t("parish_income"), ("parish",), min_n=3), ["area", "n_rent", "n_sale"], PI.INDEX_VALUES, 4)


# ---- Pages, sheets and labels. ----
@query("archived_pages", "SELECT lid, 'summary' AS layout, location_raw AS location, CASE WHEN lid % 2 = 0 THEN 'House Sale' ELSE 'House' END AS type, CASE lid % 3 WHEN 0 THEN '5' WHEN 1 THEN '7' ELSE '1' END AS bedrooms, '1' AS bathrooms, CASE WHEN lid % 2 = 0 THEN 'Ugx ' || CAST(lid AS VARCHAR) END AS price, CASE WHEN lid % 2 <> 0 THEN 'Ugx ' || CAST(lid AS VARCHAR) END AS rent, 'fine home ' || CAST(lid AS VARCHAR) AS description, '3 bedroom house for sale in ' || location_raw AS headline FROM listing_raw", ("listing_raw",))
def archived_pages(t):
    status, rooms = F.when(F.col("lid") % 2 == 0, "For sale").otherwise("For rent"), F.when(F.col("lid") % 3 == 0, "Five").when(F.col("lid") % 3 == 1, "7").otherwise("one")
    text = F.concat(F.lit("3 bedroom house for sale in "), "location_raw", F.lit(", QUICK SUMMARY Code: 1 Location: "), "location_raw", F.lit(" District: "), "region_raw", F.lit(" Price: Ugx "), F.col("lid").cast("string"), F.lit(" Category: House BedRooms: "), rooms, F.lit(" Bathrooms: one Size 25 Decimals Tenure Private Mailo Status "), status, F.lit(" Agent x DESCRIPTION fine home "), F.col("lid").cast("string"), F.lit(" Tell a friend more"))
    return t("listing_raw").select("lid", C.archived_page(text, ("Location", "Rooms")).alias("p")).select("lid", *[f"p.{c}" for c in ("layout", "location", "type", "bedrooms", "bathrooms", "price", "rent", "description", "headline")])


@query("detail_pages", "SELECT lid, CAST(lid AS VARCHAR) AS source_id, CASE WHEN lid % 2 = 0 THEN 'sale' ELSE 'rent' END AS listing_type, '4 bedroom home' AS title, 'first line second line' AS description, CASE WHEN lid % 2 <> 0 THEN 'per month' END AS price_period, '4' AS bedrooms_raw FROM listing_raw", ("listing_raw",))
def detail_pages(t):
    status = F.when(F.col("lid") % 2 == 0, "For Sale").otherwise("For Rent")
    lines = F.array(F.lit("# 4 bedroom home, code: 233, today"), F.lit("QUICK SUMMARY"), F.lit("Code:"), F.col("lid").cast("string"), F.lit("Price"), F.lit("Ugx 5"), F.lit("BedRooms:"), F.lit("Four"), F.lit("Status:"), status, F.lit("DESCRIPTION"), F.lit("first line"), F.lit("second line"), F.lit("Reviews (2)"), F.lit("no part of it"))
    return t("listing_raw").select("lid", C.detail_page(lines).alias("p")).select("lid", *[f"p.{c}" for c in ("source_id", "listing_type", "title", "description", "price_period", "bedrooms_raw")])


@query("wide_quarters", ", q AS (SELECT year(month) AS y, quarter(month) AS q, avg(value) AS v, count(*) AS n FROM monthly GROUP BY 1, 2), f AS (SELECT make_date(y, (q - 1) * 3 + 1, 1) AS d, v, n FROM q), l AS (SELECT d, 'a' AS area, round(v, 3) AS value FROM f UNION ALL SELECT d, 'b', CAST(n AS DOUBLE) FROM f) SELECT CAST(year(d) - CAST(month(d) < 7 AS INTEGER) AS VARCHAR) || '/' || CAST((year(d) - CAST(month(d) < 7 AS INTEGER) + 1) % 100 AS VARCHAR) AS fy, CAST(d AS VARCHAR) AS period_start, area, value FROM l WHERE d >= (SELECT min(d) FROM f WHERE month(d) = 7)", ("monthly",))
def wide_quarters(t):
    m = F.col("month")
    q = t("monthly").groupBy(F.trunc("month", "quarter").alias("month")).agg(F.avg("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    first = q.filter(F.month("month") == 7).agg(F.min("month").alias("d0"))
    sheet = q.join(F.broadcast(first)).filter("month >= d0").select("month", F.when(F.month(m) == 7, F.concat(F.year(m).cast("string"), F.lit("/"), F.pmod(F.year(m) + 1, F.lit(100)).cast("string"))).alias("fy"), F.concat(F.lit("Q"), F.pmod(F.quarter(m) + 1, F.lit(4)) + 1).alias("quarter"), "a", "b")  # one row
    return C.wide_quarters(sheet, "month", "fy", "quarter", ["a", "b"]).select("fy", F.col("period_start").cast("string").alias("period_start"), "area", "value")


@query("scaled_unit", "SELECT CASE WHEN quantile_cont(price, 0.75) >= 1e9 THEN 1e9 WHEN quantile_cont(price, 0.75) >= 1e6 THEN 1e6 WHEN quantile_cont(price, 0.75) >= 1e3 THEN 1e3 ELSE 1e0 END AS unit, 'million' AS word FROM index_listings", ("index_listings",))
def scaled_unit(t):
    return S.scaled_unit(t("index_listings"), "price")


@query("label_counts", PS.PIP + PS.KNN + ", q AS (SELECT CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM z JOIN l USING (id)) SELECT k AS quadrant, CAST(count(quadrant) AS BIGINT) AS n FROM (VALUES ('HH'), ('LL'), ('HL'), ('LH'), ('none')) v(k) LEFT JOIN q ON quadrant = k GROUP BY 1", ("points", "units"))
def label_counts(t):
    return S.label_counts(S.local_moran(PS._values(t), S.knn_weights(PS._areas(t), 6)), "quadrant", ["HH", "LL", "HL", "LH", "none"])

"""Queries over snapshots, windows, series, sets and record parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators import relational as R
from hearthframe.sources import records as S

from .registry import query


@query("latest_snapshot", "SELECT source, source_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY scraped_at DESC, event_id DESC) AS n FROM snapshots) WHERE n = 1", ("snapshots",))
def latest_snapshot(t):
    return R.latest_snapshot(t("snapshots"), ["source", "source_id"], ["scraped_at", "event_id"]).select("source", "source_id", "event_id", F.round("value", 6).alias("value"))


@query("first_seen", "SELECT source, source_id, min(scraped_at) AS first_seen, CAST(count(*) AS BIGINT) AS n_postings FROM snapshots GROUP BY 1, 2", ("snapshots",))
def first_seen(t):
    return t("snapshots").groupBy("source", "source_id").agg(F.min("scraped_at").alias("first_seen"), F.count(F.lit(1)).alias("n_postings"))


@query("done_antijoin", "SELECT o_orderkey AS code FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def done_antijoin(t):
    done = t("orders").filter("o_orderkey % 3 = 0").select("o_orderkey")
    return t("orders").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("code"))


@query("both_periods", "SELECT point FROM panel WHERE post = 0 INTERSECT SELECT point FROM panel WHERE post = 1", ("panel",))
def both_periods(t):
    p = t("panel")
    return p.filter("post = 0").select("point").intersect(p.filter("post = 1").select("point"))


@query("only_before", "SELECT row_id FROM panel WHERE post = 0 EXCEPT SELECT row_id FROM panel WHERE post = 1", ("panel",))
def only_before(t):
    p = t("panel")
    return p.filter("post = 0").select("row_id").exceptAll(p.filter("post = 1").select("row_id")).distinct()


@query("union_first", "SELECT unit, region_id FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY o) AS n FROM (SELECT unit, region_id, 0 AS o FROM units WHERE unit < 15 UNION ALL SELECT unit, region_id + 10, 1 FROM units WHERE unit > 10)) WHERE n = 1", ("units",))
def union_first(t):
    u = t("units").select("unit", "region_id")
    both = u.filter("unit < 15").withColumn("o", F.lit(0)).unionByName(u.filter("unit > 10").withColumn("region_id", F.col("region_id") + 10).withColumn("o", F.lit(1)))
    return R.first_rows(both, ["unit"], [F.col("o")]).drop("o")


@query("unit_medians", "SELECT nation, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(amount0, 0.25), 4) AS q25, CASE WHEN count(*) >= 500 THEN round(quantile_cont(amount0, 0.5), 4) END AS median, round(quantile_cont(amount0, 0.75), 4) AS q75 FROM listing_raw GROUP BY 1", ("listing_raw",))
def unit_medians(t):
    g = t("listing_raw").groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.percentile("amount0", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return g.select("nation", "n", F.round(F.col("p")[0], 4).alias("q25"), F.when(F.col("n") >= 500, F.round(F.col("p")[1], 4)).alias("median"), F.round(F.col("p")[2], 4).alias("q75"))


@query("mode_unit", "SELECT custkey, min(nation) AS nation FROM (SELECT custkey, lid % 4 AS nation, count(*) AS c, max(count(*)) OVER (PARTITION BY custkey) AS m FROM listing_raw GROUP BY 1, 2) WHERE c = m GROUP BY 1", ("listing_raw",))
def mode_unit(t):
    return t("listing_raw").groupBy("custkey").agg(F.mode(F.col("lid") % 4, True).alias("nation"))


@query("value_counts", "SELECT property_type, CAST(count(*) AS BIGINT) AS n FROM listing_raw GROUP BY 1", ("listing_raw",))
def value_counts(t):
    return t("listing_raw").groupBy("property_type").agg(F.count(F.lit(1)).alias("n"))


@query("weighted_means", "SELECT district, round(sum(households * income) / sum(households), 4) AS arithmetic, round(exp(sum(households * ln(income)) / sum(households)), 4) AS geometric, round(stddev_samp(income), 4) AS sd, round(stddev_pop(income), 4) AS sd_pop, CAST(count(DISTINCT subcounty) AS BIGINT) AS subcounties FROM parish_income GROUP BY 1", ("parish_income",))
def weighted_means(t):
    h = F.col("households")
    return t("parish_income").groupBy("district").agg(F.round(F.sum(h * F.col("income")) / F.sum(h), 4).alias("arithmetic"), F.round(F.exp(F.sum(h * F.ln("income")) / F.sum(h)), 4).alias("geometric"), F.round(F.stddev_samp("income"), 4).alias("sd"), F.round(F.stddev_pop("income"), 4).alias("sd_pop"), F.count_distinct("subcounty").alias("subcounties"))


@query("budget_share", "SELECT nation, round(avg(CASE WHEN amount0 IS NOT NULL THEN CAST(amount0 <= 200000 AS DOUBLE) END), 6) AS share, CAST(count(*) FILTER (WHERE listing_type = 'rent') AS BIGINT) AS rents, CAST(count(*) FILTER (WHERE listing_type = 'sale') AS BIGINT) AS sales FROM listing_raw GROUP BY 1", ("listing_raw",))
def budget_share(t):
    return t("listing_raw").groupBy("nation").agg(F.round(F.avg((F.col("amount0") <= 200000).cast("double")), 6).alias("share"), F.count_if(F.col("listing_type") == "rent").alias("rents"), F.count_if(F.col("listing_type") == "sale").alias("sales"))


@query("spearman", "SELECT round(corr(ra, rb), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM (SELECT rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2e0 AS ra, rank() OVER (ORDER BY households) + (count(*) OVER (PARTITION BY households) - 1) / 2e0 AS rb FROM parish_income)", ("parish_income",))
def spearman(t):
    return R.spearman(t("parish_income"), "income", "households").select(F.round("spearman", 6).alias("spearman"), "n")


@query("ols_line", "SELECT district, round(regr_slope(ln(income), ln(households)), 6) AS slope, round(regr_intercept(ln(income), ln(households)), 6) AS intercept, round(regr_r2(ln(income), ln(households)), 6) AS r2 FROM parish_income GROUP BY 1", ("parish_income",))
def ols_line(t):
    y, x = F.ln("income"), F.ln("households")
    return t("parish_income").groupBy("district").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


Q = "quarterly AS (SELECT CAST(date_trunc('quarter', month) AS DATE) AS q, avg(value) AS v FROM monthly GROUP BY 1)"


@query("qoq_rebased", f", {Q} SELECT CAST(q AS VARCHAR) AS q, round(100 * v / first_value(v) OVER (ORDER BY q), 6) AS index, round(v / lag(v) OVER (ORDER BY q) - 1, 6) AS change FROM quarterly", ("monthly",))
def qoq_rebased(t):
    q = t("monthly").groupBy(F.trunc("month", "quarter").alias("q")).agg(F.avg("value").alias("v"))
    return R.rebased(q.withColumn("g", F.lit(1)), ["g"], "q", "v").select(F.col("q").cast("string").alias("q"), F.round("index", 6).alias("index"), F.round("change", 6).alias("change"))


@query("cagr", f", {Q}, l AS (SELECT *, lag(v, 4) OVER (ORDER BY q) AS b FROM quarterly) SELECT round(pow(max_by(v, q) / min_by(v, q), 1 / (date_diff('day', min(q), max(q)) / 365.25e0)) - 1, 6) AS cagr, round(max_by(v, q) / max_by(b, q) - 1, 6) AS last_change FROM l", ("monthly",))
def cagr(t):
    q = t("monthly").groupBy(F.trunc("month", "quarter").alias("q")).agg(F.avg("value").alias("v"))
    return R.growth(q, "q", "v", 4).select(F.round("cagr", 6).alias("cagr"), F.round("last_change", 6).alias("last_change"))


@query(
    "asof_nearest",
    ", d AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS day FROM orders), m AS (SELECT month, value FROM monthly WHERE month(month) % 2 = 1) SELECT CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM (SELECT day, value, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', month, day)), month) AS n FROM d, m) WHERE n = 1",
    ("monthly",),
)
def asof_nearest(t):
    d = t("orders").select(F.date_add(F.trunc("o_orderdate", "quarter"), (F.col("o_orderkey") % 90).cast("int")).alias("day")).distinct()
    return R.as_of_nearest(d, t("monthly").filter("month(month) % 2 = 1").withColumnRenamed("month", "m"), "day", "m", "value").select(F.col("day").cast("string").alias("day"), F.round("value", 6).alias("value"))


@query(
    "code_date",
    """WITH cap AS (SELECT o_orderkey AS code, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders),
  b AS (SELECT floor(code / 2000) * 2000 + 1000 AS bin, quantile_cont(d, 0.05) AS d FROM cap GROUP BY 1 HAVING count(*) >= 10),
  a AS (SELECT bin, max(d) OVER (ORDER BY bin) AS day FROM b),
  s AS (SELECT bin AS x0, day AS y0, lead(bin) OVER (ORDER BY bin) AS x1, lead(day) OVER (ORDER BY bin) AS y1, row_number() OVER (ORDER BY bin) AS k FROM a)
  SELECT code, round(CASE WHEN x1 IS NULL OR code <= x0 THEN y0 ELSE y0 + (y1 - y0) * (code - x0) / (x1 - x0) END, 6) AS day FROM cap JOIN s ON (k = 1 OR code >= x0) AND (x1 IS NULL OR code < x1)""",
)
def code_date(t):
    cap = t("orders").select(F.col("o_orderkey").alias("code"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("d"))
    out = R.interpolate(cap.select("code"), R.monotone_anchors(cap, "code", "d"), "code", "bin", "day")
    return out.select("code", F.round("y", 6).alias("day"))


@query("cpi_splice", ", o AS (SELECT month, value FROM monthly WHERE month <= DATE '1999-06-01'), n AS (SELECT month, value / 1000 AS value FROM monthly WHERE month >= DATE '1999-01-01'), r AS (SELECT n.value / o.value AS r FROM n JOIN o USING (month) WHERE month = DATE '1999-01-01') SELECT CAST(month AS VARCHAR) AS month, round(coalesce(n.value, o.value * r), 8) AS value FROM o FULL JOIN n USING (month), r", ("monthly",))
def cpi_splice(t):
    m = t("monthly").select("month", "value")
    old, new = m.filter("month <= DATE'1999-06-01'"), m.filter("month >= DATE'1999-01-01'").withColumn("value", F.col("value") / 1000)
    return R.splice(old, new, "month", "value", "1999-01-01").select(F.col("month").cast("string").alias("month"), F.round("value", 8).alias("value"))


@query("lending_rate", ", m AS (SELECT month, CASE WHEN n % 3 <> 0 THEN value END AS v FROM monthly) SELECT round(avg(v), 6) AS mean FROM (SELECT v FROM m WHERE v IS NOT NULL ORDER BY month DESC LIMIT 12)", ("monthly",))
def lending_rate(t):
    return R.last_mean(t("monthly").withColumn("v", F.when(F.col("n") % 3 != 0, F.col("value"))), "month", "v", 12).select(F.round("mean", 6).alias("mean"))


@query("forward_fill", ", m AS (SELECT month, CASE WHEN month(month) = 7 THEN year(month) END AS fy FROM monthly) SELECT CAST(month AS VARCHAR) AS month, last_value(fy IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS fy FROM m WHERE month >= DATE '1995-07-01'", ("monthly",))
def forward_fill(t):
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return t("monthly").filter("month >= DATE'1995-07-01'").select(F.col("month").cast("string").alias("month"), F.last(F.when(F.month("month") == 7, F.year("month").cast("bigint")), True).over(w).alias("fy"))


CURVE = ", a AS (SELECT nation, exp(sum(households * ln(income)) / sum(households)) AS inc, sum(households) AS hh FROM parish_income WHERE income > 0 GROUP BY 1), l AS (SELECT nation, count(*) AS n FROM listing_raw GROUP BY 1), j AS (SELECT a.*, CAST(n AS DOUBLE) AS n FROM a JOIN l USING (nation)), c AS (SELECT *, sum(hh) OVER w / sum(hh) OVER () AS x, sum(n) OVER w / sum(n) OVER () AS y FROM j WINDOW w AS (ORDER BY inc, nation ROWS UNBOUNDED PRECEDING))"


def _curve(t):
    h = F.col("households")
    a = t("parish_income").filter("income > 0").groupBy("nation").agg(F.exp(F.sum(h * F.ln("income")) / F.sum(h)).alias("inc"), F.sum(h).alias("hh"))
    n = t("listing_raw").groupBy("nation").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return R.concentration(a.join(n, "nation"), "hh", "n", ["inc", "nation"])


@query("concentration_curve", CURVE + " SELECT nation, round(x, 8) AS x, round(y, 8) AS y, round(1000 * n / hh, 6) AS per_1000 FROM c", ("parish_income", "listing_raw"))
def concentration_curve(t):
    return _curve(t).select("nation", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), F.round(1000 * F.col("n") / F.col("hh"), 6).alias("per_1000"))


@query(
    "concentration_index",
    CURVE + ", s AS (SELECT coalesce(lag(x) OVER (ORDER BY x), 0) AS x0, coalesce(lag(y) OVER (ORDER BY x), 0) AS y0, x AS x1, y AS y1 FROM c) SELECT round(1 - 2 * sum((x1 - x0) * (y0 + y1) / 2), 6) AS c, round(1 - max(CASE WHEN x0 < 0.8 AND x1 >= 0.8 THEN y0 + (y1 - y0) * (0.8 - x0) / (x1 - x0) END), 6) AS top20, round(max(CASE WHEN x0 < 0.5 AND x1 >= 0.5 THEN y0 + (y1 - y0) * (0.5 - x0) / (x1 - x0) END), 6) AS bottom50 FROM s",
    ("parish_income", "listing_raw"),
)
def concentration_index(t):
    return R.concentration_index(_curve(t)).select(*[F.round(c, 6).alias(c) for c in ("c", "top20", "bottom50")])


@query("quantile_bins", ", e AS (SELECT list_distinct(quantile_cont(amount0, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q FROM listing_raw), s AS (SELECT list_sort(q) AS q FROM e) SELECT lid, CAST(len(list_filter(q[2:len(q) - 1], lambda x: x < amount0)) + 1 AS INTEGER) AS bin FROM listing_raw, s", ("listing_raw",))
def quantile_bins(t):
    return R.quantile_bins(t("listing_raw"), "amount0", 5).select("lid", "bin")


@query("winsorised_with_gaps", ", e AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM gappy_points WHERE NOT isnan(value)) SELECT pid, CASE WHEN NOT isnan(value) THEN round(least(greatest(value, lo), hi), 4) END AS value FROM gappy_points, e", ("gappy_points",))
def winsorised_with_gaps(t):
    return R.winsorised(t("gappy_points").select("pid", "value"), "value", 0.05, 0.95).select("pid", F.round("value", 4).alias("value"))


@query("winsorised", ", e AS (SELECT quantile_cont(amount0, 0.05) AS lo, quantile_cont(amount0, 0.95) AS hi FROM listing_raw) SELECT lid, round(least(greatest(amount0, lo), hi), 4) AS amount0 FROM listing_raw, e", ("listing_raw",))
def winsorised(t):
    return R.winsorised(t("listing_raw"), "amount0", 0.05, 0.95).select("lid", F.round("amount0", 4).alias("amount0"))


@query("pivot_scenarios", "SELECT nation, round(avg(amount0) FILTER (WHERE source = 'alpha'), 4) AS alpha, round(avg(amount0) FILTER (WHERE source = 'beta'), 4) AS beta, round(avg(amount0) FILTER (WHERE source = 'gamma'), 4) AS gamma FROM listing_raw GROUP BY 1", ("listing_raw",))
def pivot_scenarios(t):
    return t("listing_raw").groupBy("nation").pivot("source", ["alpha", "beta", "gamma"]).agg(F.round(F.avg("amount0"), 4))


@query("unpivot_areas", "SELECT unit, edge, value FROM (SELECT unit, x0, y0, x1, y1 FROM units) UNPIVOT (value FOR edge IN (x0, y0, x1, y1))", ("units",))
def unpivot_areas(t):
    u = t("units").select("unit", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return u.unpivot("unit", ["x0", "y0", "x1", "y1"], "edge", "value")


@query("one_hot", "SELECT lid, " + ", ".join(f"CAST(property_type = '{v}' AS INTEGER) AS {n}" for n, v in (("p_apartment", "apartment"), ("p_flat", "flat"), ("p_house", "house"), ("p_land", "Land"))) + " FROM listing_raw", ("listing_raw",))
def one_hot(t):
    return t("listing_raw").select("lid", *[(F.col("property_type") == v).cast("int").alias(n) for n, v in (("p_apartment", "apartment"), ("p_flat", "flat"), ("p_house", "house"), ("p_land", "Land"))])


@query("top_k_lumped", ", c AS (SELECT property_type AS kind, count(*) AS n FROM listing_raw GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS o FROM c) SELECT CASE WHEN o <= 3 THEN kind ELSE 'other' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1", ("listing_raw",))
def top_k_lumped(t):
    c = t("listing_raw").groupBy(F.col("property_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("o", F.row_number().over(Window.orderBy(F.desc("n"), "kind")))
    return r.groupBy(F.when(F.col("o") <= 3, F.col("kind")).otherwise("other").alias("kind")).agg(F.sum("n").alias("n"))


@query("hash_sample", "SELECT lid FROM listing_raw WHERE ((lid * 7919) % 1000 + 1000) % 1000 < 250", ("listing_raw",))
def hash_sample(t):
    return t("listing_raw").filter(F.pmod(F.col("lid") * 7919, F.lit(1000)) < 250).select("lid")


@query("dedup_report", ", d AS (SELECT source, source_id, count(*) AS n FROM listing_raw GROUP BY 1, 2) SELECT coalesce(source, 'all') AS source, CAST(sum(n) AS BIGINT) AS records_in, CAST(count(*) AS BIGINT) AS unique_out, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 6) AS share_duplicate FROM d GROUP BY ROLLUP (source)", ("listing_raw",))
def dedup_report(t):
    d = t("listing_raw").groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n"))
    g = d.rollup("source").agg(F.sum("n").alias("records_in"), F.count(F.lit(1)).alias("unique_out"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), "records_in", "unique_out", F.round(1 - F.col("unique_out") / F.col("records_in"), 6).alias("share_duplicate"))


@query(
    "title_grammar",
    r""", p AS (SELECT lid, regexp_extract(title, '^(.*?)\s+in\s+(.+?)(?:,\s*([^,]+?))?\s+for\s+(rent|sale)\s*$', ['a', 'b', 'c', 'd'], 'i') AS m FROM listing_raw)
  SELECT lid, nullif(trim(regexp_replace(regexp_replace(m.a, '^(furnished|unfurnished|\d+\s*bdrm)\s*', '', 'i'), '\d+\s*bdrm\s*', '', 'gi')), '') AS ptype, nullif(m.b, '') AS place, nullif(m.c, '') AS admin, lower(nullif(m.d, '')) AS deal FROM p""",
    ("listing_raw",),
)
def title_grammar(t):
    return t("listing_raw").select("lid", S.title_parts(F.col("title")).alias("p")).select("lid", "p.ptype", "p.place", "p.admin", "p.deal")


@query("json_attrs", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attrs(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


AD = "'{\"id\":' || CAST(lid AS STRING) || ',\"title\":\"' || title || '\",\"url\":\"/ad/' || CAST(lid AS STRING) || '?x=1\",\"price_obj\":{\"value\":' || CAST(lid * 10 AS STRING) || ',\"view\":\"USh 5\"},\"attrs\":[{\"name\":\"Bedrooms\",\"value\":\"' || CAST(lid % 4 AS STRING) || '\"},{\"name\":\"property SIZE\",\"value\":\"' || CAST(lid % 90 AS STRING) || '\",\"unit\":\"sqm\"}],\"user_id\":' || CAST(custkey AS STRING) || '}'"


@query(
    "json_adverts",
    r", p AS (SELECT *, regexp_extract(title, '^(.*?)\s+in\s+(.+?)(?:,\s*([^,]+?))?\s+for\s+(rent|sale)\s*$', 4, 'i') AS deal FROM listing_raw) SELECT CAST(lid AS VARCHAR) AS source_id, '/ad/' || CAST(lid AS VARCHAR) AS url, lower(deal) AS listing_type, CAST(CAST(lid * 10 AS DOUBLE) AS VARCHAR) AS price_raw, 'UGX' AS currency_raw, CAST(lid % 4 AS VARCHAR) AS bedrooms_raw, CAST(lid % 90 AS VARCHAR) AS size_raw, 'sqm' AS size_unit_raw, substr(sha256('alpha|' || CAST(custkey AS VARCHAR)), 1, 16) AS agent_key FROM p",
    ("listing_raw",),
)
def json_adverts(t):
    rows = t("listing_raw").select(F.expr(AD).alias("json"))
    return S.adverts(rows, "alpha", "houses-for-rent").select("source_id", "url", "listing_type", "price_raw", "currency_raw", "bedrooms_raw", "size_raw", "size_unit_raw", "agent_key")


@query(
    "html_text",
    r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages",
)
def html_text(t):
    return t("pages").select("page_id", F.md5(S.page_text(F.col("html")).cast("binary")).alias("text_md5"), S.page_title(F.col("html")).alias("title"))


@query(
    "url_parts",
    ", u AS (SELECT lid, ['for-rent', 'houses'] AS a, CASE WHEN lid % 3 = 0 THEN ['showtype'] ELSE [] END AS b, lower(region_raw) || '-region' AS region, lower(replace(location_raw, ' ', '-')) AS district, lid % 2 AS short FROM listing_raw) SELECT lid, 'rent' AS deal, 'houses' AS ptype, region, CASE WHEN short = 0 THEN district END AS district, CAST(lid AS VARCHAR) AS id FROM u",
    ("listing_raw",),
)
def url_parts(t):
    region, district = F.concat(F.lower("region_raw"), F.lit("-region")), F.lower(F.replace("location_raw", F.lit(" "), F.lit("-")))
    url = F.concat(F.lit("https://gamma.example/for-rent/houses/"), F.when(F.col("lid") % 3 == 0, "showtype/").otherwise(""), region, F.when(F.col("lid") % 2 == 0, F.concat(F.lit("/"), district)).otherwise(""), F.lit("/"), F.col("lid").cast("string"), F.lit("-3-bedroom?x=1"))
    return t("listing_raw").select("lid", S.url_parts(url).alias("u")).select("lid", "u.deal", "u.ptype", "u.region", "u.district", "u.id")


@query("summary_grammar", ", s AS (SELECT lid, location_raw, region_raw, lid % 9 AS b, CASE WHEN lid % 2 = 0 THEN 'For sale' ELSE 'For rent' END AS st FROM listing_raw) SELECT lid, location_raw AS location, region_raw AS district, 'Ugx ' || CAST(lid AS VARCHAR) AS price, CAST(b AS VARCHAR) AS bedrooms, '25 Decimals' AS size, 'Private Mailo' AS tenure, st AS status, st = 'For sale' AS is_sale FROM s", ("listing_raw",))
def summary_grammar(t):
    status = F.when(F.col("lid") % 2 == 0, "For sale").otherwise("For rent")
    text = F.concat(F.lit("x QUICK SUMMARY Code: 1 Location: "), "location_raw", F.lit(" District: "), "region_raw", F.lit(" Price: Ugx "), F.col("lid").cast("string"), F.lit(" Category: House BedRooms: "), (F.col("lid") % 9).cast("string"), F.lit(" Bathrooms: one Size 25 Decimals Tenure Private Mailo Status "), status, F.lit(" Agent x DESCRIPTION y"))
    return t("listing_raw").select("lid", S.summary_grammar(text).alias("s")).select("lid", "s.*")


@query("specification_fields", "SELECT lid, location_raw AS location, CAST(lid % 7 AS VARCHAR) AS rooms, property_type AS kind FROM listing_raw", ("listing_raw",))
def specification_fields(t):
    text = F.concat(F.lit("Location : "), "location_raw", F.lit(" Rooms: "), (F.col("lid") % 7).cast("string"), F.lit(" Kind of home: "), "property_type")
    m = S.specification_fields(text, ("Location", "Rooms", "Kind of home"))
    return t("listing_raw").select("lid", m["Location"].alias("location"), m["Rooms"].alias("rooms"), m["Kind of home"].alias("kind"))


@query("linked_data", "SELECT lid, title AS name, CAST(lid AS VARCHAR) AS price, 'UGX' AS currency FROM listing_raw", ("listing_raw",))
def linked_data(t):
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"Other"}</script><script type="application/ld+json">{"@type":"RealEstateListing","name":"'), "title", F.lit('","offers":{"price":"'), F.col("lid").cast("string"), F.lit('","priceCurrency":"UGX"}}</script></html>'))
    d = S.linked_listing(html)
    return t("listing_raw").select("lid", d["name"].alias("name"), d["offers"]["price"].alias("price"), d["offers"]["priceCurrency"].alias("currency"))


@query("sitemap", "SELECT CAST(lid AS BIGINT) AS code, '3 bed for sale in ' || n_name AS title, n_name AS place FROM (SELECT DISTINCT lid % 500 AS lid, (lid % 500) % 25 AS n FROM listing_raw) JOIN nation ON n_nationkey = n", ("listing_raw",))
def sitemap(t):
    n = t("nation").select(F.col("n_nationkey").alias("n"), "n_name")
    codes = t("listing_raw").select((F.col("lid") % 500).alias("lid")).withColumn("n", F.col("lid") % 25)
    rows = codes.join(n, "n")
    xml = F.concat(F.lit("<url><loc>https://beta.example/HouseDetails?HouseCode="), F.col("lid").cast("string"), F.lit("&amp;Title=3+bed+for+sale+in+"), F.replace("n_name", F.lit(" "), F.lit("+")), F.lit("#top</loc></url>"))
    return S.sitemap_frame(rows.select(xml.alias("xml"))).select("code", "title", "place")


@query("raw_layer", "SELECT source_id, source, price_raw, title, CAST(NULL AS DOUBLE) AS lat FROM listing_raw", ("listing_raw",))
def raw_layer(t):
    return S.to_raw(t("listing_raw")).select("source_id", "source", "price_raw", "title", "lat")


@query("raw_files", "SELECT CAST(lid AS VARCHAR) AS source_id, source, title, 'said: \"as new\"' || chr(10) || title AS description, price_raw, CAST(NULL AS VARCHAR) AS tenure_raw FROM listing_raw WHERE source <> 'gamma' UNION ALL SELECT CAST(lid AS VARCHAR), source, title, NULL, price_raw, NULL FROM listing_raw WHERE source = 'gamma'", ("listing_raw",))
def raw_files(t):
    """Listings written as CSV files of two portals with columns of their own, and read back as the raw layer."""
    import uuid

    from hearthframe import shared_folder

    rows = t("listing_raw").select(F.col("lid").cast("string").alias("source_id"), "source", "title", F.concat_ws("\n", F.lit('said: "as new"'), "title").alias("description"), "price_raw")
    root = f"{shared_folder(rows.sparkSession)}/raw-{uuid.uuid4().hex}"
    for name, part in (("a", rows.filter("source <> 'gamma'")), ("b", rows.filter("source = 'gamma'").select("price_raw", "title", "source_id", "source"))):
        part.write.options(header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/{name}")
    back = S.read_raw(rows.sparkSession, f"{root}/*")
    return back.select("source_id", "source", "title", F.when(F.col("description") == F.concat_ws("\n", F.lit('said: "as new"'), "title"), F.col("description")).alias("description"), "price_raw", "tenure_raw")


@query("extract_import", "SELECT CAST(lid AS VARCHAR) AS source_id, price_raw, listing_type, 'beta' AS source FROM listing_raw", ("listing_raw",))
def extract_import(t):
    x = t("listing_raw").select(F.col("lid").alias("HouseCode"), F.col("price_raw").alias("Price"), F.concat(F.lit("For "), F.initcap("listing_type")).alias("Status"))
    return S.read_extract(x, "beta").select("source_id", "price_raw", "listing_type", "source")


@query("earliest_capture", "SELECT user_id AS code, min(ts) AS first, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def earliest_capture(t):
    return t("events").groupBy(F.col("user_id").alias("code")).agg(F.min("ts").alias("first"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("hierarchy_fill", "SELECT r_name AS l1, n_name AS l2, c_name AS l3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hierarchy_fill(t):
    r, n, c = t("region"), t("nation"), t("customer")
    o = lambda a, b, d: (F.col(a).cast("bigint") * 10**15 + b * 10**12 + d).cast("bigint")
    top = r.select(o("r_regionkey", F.lit(0), F.lit(0)).alias("ordinal"), F.lit(0).alias("indent"), F.col("r_name").alias("text"))
    mid = n.select(o("n_regionkey", F.col("n_nationkey") + 1, F.lit(0)).alias("ordinal"), F.lit(1).alias("indent"), F.col("n_name").alias("text"))
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(o("n_regionkey", F.col("n_nationkey") + 1, F.col("c_custkey") + 1).alias("ordinal"), F.lit(2).alias("indent"), F.col("c_name").alias("text"))
    return S.hierarchy_paths(top.unionByName(mid).unionByName(low)).select("l1", "l2", "l3")


@query("macro_rates", ", m AS (SELECT month, CASE WHEN n % 2 = 0 THEN value END AS a, CASE WHEN n % 5 <> 0 THEN value * 1.01 END AS b FROM monthly) SELECT CAST(month AS VARCHAR) AS month, round(coalesce(a, b), 6) AS rate FROM m WHERE coalesce(a, b) IS NOT NULL", ("monthly",))
def macro_rates(t):
    m = t("monthly").select("month", F.when(F.col("n") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("n") % 5 != 0, F.col("value") * 1.01).alias("b"))
    return S.macro_rates(m, "a", "b").select(F.col("month").cast("string").alias("month"), F.round("rate", 6).alias("rate"))


@query("jobs_split", ", w AS (SELECT *, sum(households) OVER (PARTITION BY nation) AS tot FROM parish_income) SELECT parish, round(1000.0 * (nation + 1) * households / tot, 6) AS allotted FROM w", ("parish_income",))
def jobs_split(t):
    totals = t("nation").select(F.col("n_nationkey").alias("nation"), (F.lit(1000.0) * (F.col("n_nationkey") + 1)).alias("total"))
    return S.split_total(t("parish_income"), totals, "nation", "households", "total").select("parish", F.round("allotted", 6).alias("allotted"))


@query("building_grid", "SELECT CAST(floor((y + 5.0) / 500) AS BIGINT) AS row, CAST(floor((x + 4.0) / 500) AS BIGINT) AS col, round(sum(80.0), 4) AS area, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1, 2", ("points",))
def building_grid(t):
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    rows = t("points").select(F.array(at(0.0, 0.0), at(8.0, 0.0), at(8.0, 10.0), at(0.0, 10.0)).alias("ring"))
    return S.footprint_cells(rows, "ring", 500.0).select("row", "col", F.round("area", 4).alias("area"), "n")

"""Queries over points, units, neighbours, spatial statistics and road graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import geo
from hearthframe.operators import graph as G
from hearthframe.operators import spatial as S

from .registry import query


def ring(*names: str):
    x0, y0, x1, y1 = (F.col(n).cast("double") for n in names)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))


@query("utm_project", f"SELECT pid, round({geo.utm_sql('(32 + x / 10000)', '(y / 20000)')[0]}, 3) AS x, round({geo.utm_sql('(32 + x / 10000)', '(y / 20000)')[1]}, 3) AS y FROM points", ("points",))
def utm_project(t):
    p = geo.utm(32 + F.col("x") / 10000, F.col("y") / 20000)
    return t("points").select("pid", p.alias("p")).select("pid", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def _tagged(t):
    u = t("units").select("unit", "region_id", ring("x0", "y0", "x1", "y1").alias("ring"))
    return S.point_in_unit(t("points"), u, "pid", "unit")


PIP = ", pip AS (SELECT pid, unit, region_id, value, x, y FROM points JOIN units ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)"


@query("point_in_unit", PIP + " SELECT pid, unit FROM pip", ("points", "units"))
def point_in_unit(t):
    return _tagged(t)


@query("analysis_unit", PIP + ", n AS (SELECT *, count(*) OVER (PARTITION BY unit) AS c FROM pip) SELECT pid, CASE WHEN c >= 610 THEN 's' || CAST(unit AS VARCHAR) ELSE 'l' || CAST(region_id AS VARCHAR) END AS analysis_unit FROM n", ("points", "units"))
def analysis_unit(t):
    return S.analysis_unit(_tagged(t).join(t("units").select("unit", "region_id"), "unit"), "unit", "region_id", 610).select("pid", "analysis_unit")


@query("study_area", PIP + " SELECT unit, CAST(count(*) AS BIGINT) AS n FROM pip WHERE unit % 2 = 0 GROUP BY 1", ("points", "units"))
def study_area(t):
    inside = _tagged(t)
    return inside.join(t("units").filter("unit % 2 = 0").select("unit"), "unit", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("hex_grid", "SELECT c + r * 7 AS hex_id, round(1500e0 * c, 6) AS x, round(r * sqrt(3) * 1000 + CASE WHEN c % 2 = 1 THEN sqrt(3) * 500 ELSE 0 END, 6) AS y FROM range(7) a(c), range(6) b(r)")
def hex_grid(t):
    return S.hex_grid(t("region"), 1000.0, 0.0, 0.0, 8000.0, 8000.0).select("hex_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


NEAR = ", d AS (SELECT pid, poi, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS dist FROM points CROSS JOIN poi)"


@query("nearest_poi", NEAR + " SELECT pid, min_by(poi, (dist, poi)) AS poi, round(min(dist), 6) AS dist FROM d GROUP BY 1", ("points", "poi"))
def nearest_poi(t):
    return S.nearest(t("points"), t("poi"), "pid", "poi").select("pid", "poi", F.round("dist", 6).alias("dist"))


@query("count_within", NEAR + " SELECT pid, CAST(count(*) FILTER (WHERE dist <= 1000) AS BIGINT) AS n FROM d GROUP BY 1", ("points", "poi"))
def count_within(t):
    return S.count_within(t("points"), t("poi"), "pid", 1000.0)


LINES = ", seg AS (SELECT px AS ax, py AS ay, lead(px) OVER w AS bx, lead(py) OVER w AS b_y FROM poi WINDOW w AS (PARTITION BY line ORDER BY poi)), sg AS (SELECT *, bx - ax AS dx, b_y - ay AS dy FROM seg WHERE bx IS NOT NULL)"


@query(
    "nearest_line",
    LINES + ", q AS (SELECT pid, x, y, s.*, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS k FROM points CROSS JOIN sg s), e AS (SELECT pid, sqrt(pow(ax + k * dx - x, 2) + pow(ay + k * dy - y, 2)) AS d FROM q) SELECT pid, round(min(d), 6) AS dist FROM points LEFT JOIN e USING (pid) GROUP BY 1",
    ("points", "poi"),
)
def nearest_line(t):
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("poi")
    seg = t("poi").select(F.col("px").alias("ax"), F.col("py").alias("ay"), F.lead("px").over(w).alias("bx"), F.lead("py").over(w).alias("by")).filter("bx IS NOT NULL")
    return S.nearest_line(t("points"), seg, "pid").select("pid", F.round("dist", 6).alias("dist"))


@query(
    "nearest_in_budget",
    ", o AS (SELECT poi AS oid, px AS ox, py AS oy, 20000.0 + 3000 * (poi % 40) AS budget FROM poi), d AS (SELECT oid, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS d FROM o CROSS JOIN points WHERE value <= budget) SELECT oid, round(coalesce(min(d.d), 1e12), 4) AS dist, CAST(count(d.d) AS BIGINT) AS n FROM o LEFT JOIN d USING (oid) GROUP BY 1",
    ("points", "poi"),
)
def nearest_in_budget(t):
    o = t("poi").select(F.col("poi").alias("oid"), F.col("px").alias("x"), F.col("py").alias("y"), (20000.0 + 3000 * (F.col("poi") % 40)).alias("budget"))
    q = t("points").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("rent"))
    r = S.nearest_within_budget(o, q, "oid")
    return r.select("oid", F.round(F.when(F.col("dist") == float("inf"), 1e12).otherwise(F.col("dist")), 4).alias("dist"), "n")


def _areas(t):
    return t("units").select(F.col("unit").alias("id"), (F.col("x0") + 1001 + F.col("unit") * 0.01).cast("double").alias("x"), (F.col("y0") + 1001).cast("double").alias("y"))


KNN = ", a AS (SELECT unit AS id, CAST(x0 + 1001 + unit * 0.01 AS DOUBLE) AS x, CAST(y0 + 1001 AS DOUBLE) AS y FROM units), k AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.id) AS r FROM a CROSS JOIN a b WHERE a.id <> b.id), w AS (SELECT i, j, 1 / 6e0 AS w FROM k WHERE r <= 6), v AS (SELECT unit AS id, avg(ln(value)) AS v FROM pip GROUP BY 1), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM v), z AS (SELECT id, (v - m) / s AS z FROM v, m), l AS (SELECT i AS id, sum(w * z) AS lag FROM w JOIN z ON z.id = w.j GROUP BY 1)"


def _values(t):
    return _tagged(t).join(t("points").select("pid", "value"), "pid").groupBy(F.col("unit").alias("id")).agg(F.avg(F.ln("value")).alias("v"))


@query("knn_weights", PIP + KNN + " SELECT i, j, round(w, 6) AS w FROM w", ("points", "units"))
def knn_weights(t):
    return S.knn_weights(_areas(t), 6).select("i", "j", F.round("w", 6).alias("w"))


@query("queen_weights", "SELECT a.unit AS i, b.unit AS j, round(1e0 / count(*) OVER (PARTITION BY a.unit), 6) AS w FROM units a JOIN units b ON a.unit <> b.unit AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1", ("units",))
def queen_weights(t):
    return S.queen_weights(t("units").withColumnRenamed("unit", "id")).select("i", "j", F.round("w", 6).alias("w"))


@query("moran_i", PIP + KNN + " SELECT round(sum(z * lag) / sum(z * z), 6) AS moran, round(-1e0 / (count(*) - 1), 6) AS expected, CAST(count(*) AS BIGINT) AS n FROM z JOIN l USING (id)", ("points", "units"))
def moran_i(t):
    return S.moran_i(_values(t), S.knn_weights(_areas(t), 6)).select(F.round("moran", 6).alias("moran"), F.round("expected", 6).alias("expected"), "n")


@query("lisa_quadrant", PIP + KNN + " SELECT id, round(z * lag, 5) AS local_i, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM z JOIN l USING (id)", ("points", "units"))
def lisa_quadrant(t):
    return S.local_moran(_values(t), S.knn_weights(_areas(t), 6)).select("id", F.round("local_i", 5).alias("local_i"), "quadrant")


@query("gi_star", PIP + KNN + ", ws AS (SELECT i, j FROM w UNION ALL SELECT id, id FROM v), g AS (SELECT i, sum(v) AS sv, count(*) AS k FROM ws JOIN v ON v.id = ws.j GROUP BY 1) SELECT i AS id, round((sv - m * k) / (s * sqrt((n * k - k * k) / CAST(n - 1 AS DOUBLE))), 5) AS gi FROM g, m", ("points", "units"))
def gi_star(t):
    return S.gi_star(_values(t), S.knn_weights(_areas(t), 6)).select("id", F.round("gi", 5).alias("gi"))


@query("spatial_blocks", "SELECT CAST(CAST(floor(x / 3000) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 3000) AS BIGINT) AS VARCHAR) AS block, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1", ("points",))
def spatial_blocks(t):
    return S.spatial_blocks(t("points"), 3000.0).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("class_breaks", ", e AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM points) SELECT pid, CAST(len(list_filter(q, lambda x: x < value)) AS INTEGER) AS class FROM points, e", ("points",))
def class_breaks(t):
    return S.class_breaks(t("points"), "value", 5).select("pid", "class")


@query("sectors", "SELECT CAST(floor(((degrees(atan2(y - 5000.5, x - 5000.5)) + 360) % 360) / 45) AS INTEGER) AS sector, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1", ("points",))
def sectors(t):
    return t("points").groupBy(geo.sector(F.col("x") - 5000.5, F.col("y") - 5000.5).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query("neighbourhood_points", "SELECT floor(x / 500) * 500 AS gx, floor(y / 500) * 500 AS gy, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 4) AS median FROM points GROUP BY 1, 2 HAVING count(*) >= 5", ("points",))
def neighbourhood_points(t):
    snap = lambda c: (F.floor(F.col(c) / 500) * 500).cast("double")
    return t("points").groupBy(snap("x").alias("gx"), snap("y").alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 4).alias("median")).filter("n >= 5")


def _roads(t):
    """A road from every supplier to the next and to the seventh after it."""
    return t("road_edges")


@query("road_edges", ", b AS (SELECT src AS u, dst AS v, minutes FROM road_edges UNION ALL SELECT dst, src, minutes FROM road_edges) SELECT u, v, min(minutes) AS minutes FROM b GROUP BY 1, 2", ("road_edges",))
def road_edges(t):
    return G.both_ways(_roads(t).select(F.col("src").alias("u"), F.col("dst").alias("v"), "minutes")).groupBy("u", "v").agg(F.min("minutes").alias("minutes"))


@query("road_segments", "SELECT count(*) AS n, round(sum(minutes), 4) AS minutes FROM (SELECT DISTINCT least(a.poi, b.poi) AS a, greatest(a.poi, b.poi) AS b, sqrt(pow(b.px - a.px, 2) + pow(b.py - a.py, 2)) / 1000 / 20 * 60 AS minutes FROM poi a JOIN poi b ON b.line = a.line AND b.poi = (SELECT min(c.poi) FROM poi c WHERE c.line = a.line AND c.poi > a.poi))", ("poi",))
def road_segments(t):
    rings = t("poi").groupBy(F.col("line").alias("id")).agg(F.sort_array(F.collect_list(F.struct("poi", "px", "py"))).alias("p")).select("id", F.lit(0).alias("kind"), F.transform("p", lambda v: F.struct(v["px"].alias("x"), v["py"].alias("y"))).alias("ring"))
    e = G.road_edges(rings, {0: 20.0}, 18.0)
    return e.filter("u < v").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("minutes"), 4).alias("minutes"))


@query("access_nodes", ", e AS (SELECT src AS node, kind FROM road_edges UNION ALL SELECT dst, kind FROM road_edges) SELECT node FROM e GROUP BY 1 HAVING count(DISTINCT kind) > 1 AND max(CAST(kind = 2 AS INTEGER)) = 1", ("road_edges",))
def access_nodes(t):
    return G.access_nodes(_roads(t).select("src", "dst", "kind"), 2)


# With all weights at least 1, a path within 30 minutes has at most 30 edges, so a bounded recursion is exact.
TIMES = ", b AS (SELECT u, v, min(minutes) AS minutes FROM (SELECT src AS u, dst AS v, minutes FROM road_edges UNION ALL SELECT dst, src, minutes FROM road_edges) GROUP BY 1, 2), walk AS (SELECT 3::BIGINT AS node, 0e0 AS t, 0 AS hops UNION SELECT b.v, walk.t + b.minutes, hops + 1 FROM walk JOIN b ON b.u = walk.node WHERE hops < 30 AND walk.t + b.minutes <= 30), times AS (SELECT node, min(t) AS minutes FROM walk GROUP BY 1)"


def _times(t):
    e = _roads(t).select(F.col("src").cast("bigint").alias("u"), F.col("dst").cast("bigint").alias("v"), "minutes")
    src = e.select(F.lit(3).cast("bigint").alias("node")).limit(1)
    return G.shortest_times(G.both_ways(e).groupBy("u", "v").agg(F.min("minutes").alias("minutes")), src, 30.0)


@query("shortest_time", TIMES + " SELECT node, minutes FROM times", ("road_edges",))
def shortest_time(t):
    return _times(t)


@query("cumulative_access", TIMES + " SELECT " + ", ".join(f"round(coalesce(sum(CASE WHEN minutes <= {m} THEN s_suppkey * 2.0e0 END), 0), 4) AS within_{m}" for m in (10, 20, 30)) + " FROM times JOIN supplier ON s_suppkey = node", ("road_edges",))
def cumulative_access(t):
    o = t("supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), (F.col("s_suppkey") * 2.0).alias("amount")).unionByName(t("supplier").select((F.col("s_suppkey") + 1000000).cast("bigint").alias("node"), F.lit(0.0).alias("amount")))
    return G.cumulative_access(_times(t), o, (10, 20, 30))


# ---- Access for every origin. ----
def _origins(t):
    return t("poi").select(F.col("poi").cast("bigint").alias("origin"), (F.col("px") + 50).alias("x"), (F.col("py") + 20).alias("y"))


def _nodes(t):
    return t("poi").select(F.col("poi").cast("bigint").alias("node"), F.col("px").alias("x"), F.col("py").alias("y"))


SNAPPED = ", o AS (SELECT poi AS origin, px + 50 AS x, py + 20 AS y FROM poi), po AS (SELECT origin, min_by(poi, (d, poi)) AS node, min(d) / 1000 / 4e0 * 60 AS walk FROM (SELECT origin, poi, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM o CROSS JOIN poi) GROUP BY 1)"


@query("snap_to_node", SNAPPED + " SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, round(walk, 6) AS walk FROM po", ("poi",))
def snap_to_node(t):
    return G.snap(_origins(t), _nodes(t), "origin", 4.0).withColumn("walk", F.round("walk", 6))


FRAGMENTS = ", e AS (SELECT src AS u, dst AS v, minutes FROM road_edges WHERE kind <> 2 AND minutes <= 5 UNION ALL SELECT dst, src, minutes FROM road_edges WHERE kind <> 2 AND minutes <= 5), r AS (SELECT DISTINCT u AS node, u AS l FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.node), c AS (SELECT node, min(l) AS c FROM r GROUP BY 1), big AS (SELECT c FROM c GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)"


@query("largest_component", FRAGMENTS + " SELECT u, v, minutes FROM e JOIN c ON node = u JOIN big USING (c)", ("road_edges",))
def largest_component(t):
    return G.largest_component(G.both_ways(_roads(t).filter("kind <> 2 AND minutes <= 5").select(F.col("src").alias("u"), F.col("dst").alias("v"), "minutes")))


# All edges take a minute or more, so walks within 20 minutes are few for each origin and the recursion ends.
FROM_EACH = SNAPPED + ", b AS (SELECT u, v, min(minutes) AS minutes FROM (SELECT src AS u, dst AS v, minutes FROM road_edges UNION ALL SELECT dst, src, minutes FROM road_edges) GROUP BY 1, 2), w AS (SELECT DISTINCT CAST(node AS BIGINT) AS src, CAST(node AS BIGINT) AS node, 0e0 AS t FROM po UNION SELECT w.src, b.v, w.t + b.minutes FROM w JOIN b ON b.u = w.node WHERE w.t + b.minutes <= 20), fe AS (SELECT origin, w.node, min(t) AS minutes FROM po JOIN w ON w.src = po.node GROUP BY 1, 2)"


def _from_each(t):
    e = _roads(t).select(F.col("src").cast("bigint").alias("u"), F.col("dst").cast("bigint").alias("v"), "minutes")
    o = G.snap(_origins(t), _nodes(t), "origin", 4.0)
    return o, G.times_from_each(G.both_ways(e), o, 20.0)


@query("times_from_each", FROM_EACH + " SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, minutes FROM fe", ("poi", "road_edges"))
def times_from_each(t):
    return _from_each(t)[1]


CELLS = ", c AS (SELECT 500 * floor(x / 500) + 250 AS cx, 500 * floor(y / 500) + 250 AS cy, CAST(count(*) AS DOUBLE) AS lit, sum(value) AS built, CAST(floor(x / 500) AS BIGINT) % 4 AS unit FROM points GROUP BY ALL), cs AS (SELECT *, 1000 * (unit + 1) * lit / sum(lit) OVER u AS jobs_lit, 1000 * (unit + 1) * built / sum(built) OVER u AS jobs_built, 1000 * (unit + 1) * sqrt(lit * built) / sum(sqrt(lit * built)) OVER u AS jobs_mix FROM c WINDOW u AS (PARTITION BY unit)), cn AS (SELECT cx, cy, min_by(poi, (d, poi)) AS node, min(d) / 1000 / 4e0 * 60 AS cwalk FROM (SELECT cx, cy, poi, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM c CROSS JOIN poi) GROUP BY 1, 2), m AS (SELECT origin, minutes + walk + cwalk AS reach, lit, jobs_lit, jobs_built, jobs_mix FROM fe JOIN po USING (origin) JOIN cn ON cn.node = fe.node JOIN cs USING (cx, cy))"
AMOUNTS = ("lit", "jobs_lit", "jobs_built", "jobs_mix")


@query(
    "access_by_origin",
    FROM_EACH + CELLS + " SELECT CAST(po.origin AS BIGINT) AS origin, round(any_value(walk), 6) AS access, " + ", ".join(f"round(coalesce(sum({a}) FILTER (WHERE reach <= {m}), 0), 4) AS {a}_{m}" for a in AMOUNTS for m in (10, 15, 20)) + " FROM po LEFT JOIN m USING (origin) GROUP BY 1",
    ("poi", "road_edges", "points"),
)
def access_by_origin(t):
    """Lights, and jobs of four units spread over their cells by lights, by buildings and by both, that each origin reaches within the minutes."""
    at = lambda c: 500 * F.floor(F.col(c) / 500) + 250
    grid = t("points").groupBy(at("x").cast("double").alias("x"), at("y").cast("double").alias("y"), (F.floor(F.col("x") / 500) % 4).alias("unit")).agg(F.count(F.lit(1)).cast("double").alias("lit"), F.sum("value").alias("built"))
    grid = grid.withColumn("cell", F.concat_ws("_", "x", "y"))
    totals = t("region").select((F.col("r_regionkey") % 4).cast("bigint").alias("unit")).distinct().withColumn("total", 1000.0 * (F.col("unit") + 1))
    cells = G.spread_amounts(grid, totals, {"jobs_lit": F.col("lit"), "jobs_built": F.col("built"), "jobs_mix": F.sqrt(F.col("lit") * F.col("built"))})
    o, times = _from_each(t)
    placed = G.snap(grid, _nodes(t), "cell", 4.0).join(cells.drop("x", "y"), "cell")
    found = G.access_by_origin(times, o, placed, list(AMOUNTS), (10, 15, 20))
    return found.select("origin", F.round("access", 6).alias("access"), *[F.round(c, 4).alias(c) for c in found.columns[2:]])


@query("ring_weights", "SELECT a.unit AS i, b.unit AS j, round(1e0 / count(*) OVER (PARTITION BY a.unit), 6) AS w FROM units a JOIN units b ON a.unit <> b.unit AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1", ("units",))
def ring_weights(t):
    return S.ring_weights(t("units").select(F.col("unit").alias("id"), ring("x0", "y0", "x1", "y1").alias("ring"))).select("i", "j", F.round("w", 6).alias("w"))


# An edge of the hull has no place beyond it, and none on its line outside it.
HULL = ", e AS (SELECT a.px AS ax, a.py AS ay, b.px AS bx, b.py AS b_y FROM poi a JOIN poi b ON a.poi <> b.poi WHERE NOT EXISTS (SELECT 1 FROM poi c WHERE (b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px) < 0 OR ((b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px) = 0 AND (c.px - a.px) * (c.px - b.px) + (c.py - a.py) * (c.py - b.py) > 0)))"


@query("convex_hull", HULL + " SELECT DISTINCT ax AS x, ay AS y FROM e", ("poi",))
def convex_hull(t):
    return S.convex_hull(t("poi").select(F.col("px").alias("x"), F.col("py").alias("y"))).select("x", "y")


@query("hexes_near_hull")
def hexes_near_hull(t):
    grid = S.hex_grid_over(t("poi").select(F.col("px").alias("x"), F.col("py").alias("y")), 1000.0, 6000.0)
    return S.keep_near_hull(grid, t("poi").select(F.col("px").alias("x"), F.col("py").alias("y")), "hex_id", 1000.0, 3000.0)


# ---- Unknown coordinates and values. ----
@query(
    "nearest_with_gaps",
    ", d AS (SELECT pid, poi, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS dist FROM gappy_points CROSS JOIN poi WHERE x IS NOT NULL AND NOT isnan(y)), m AS (SELECT pid, min_by(poi, (dist, poi)) AS poi, min(dist) AS dist, count(*) FILTER (WHERE dist <= 1000) AS n FROM d GROUP BY 1) SELECT pid, poi, round(dist, 6) AS dist, CAST(n AS BIGINT) AS n FROM gappy_points LEFT JOIN m USING (pid)",
    ("gappy_points", "poi"),
)
def nearest_with_gaps(t):
    near = S.nearest(t("gappy_points"), t("poi"), "pid", "poi").select("pid", "poi", F.round("dist", 6).alias("dist"))
    return near.join(S.count_within(t("gappy_points"), t("poi"), "pid", 1000.0), "pid")


GAPS = ", h AS (SELECT * FROM gappy_areas WHERE v IS NOT NULL AND NOT isnan(v)), m AS (SELECT avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM h), z AS (SELECT id, v, (v - m) / s AS z FROM h, m)"


@query("local_moran_with_gaps", GAPS + ", l AS (SELECT i AS id, sum(w * z) AS lag FROM gappy_weights JOIN z ON z.id = j GROUP BY 1) SELECT id, round(z * lag, 6) AS local_i, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z >= 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM z JOIN l USING (id)", ("gappy_areas", "gappy_weights"))
def local_moran_with_gaps(t):
    return S.local_moran(t("gappy_areas"), t("gappy_weights")).select("id", F.round("local_i", 6).alias("local_i"), "quadrant")


@query(
    "gi_star_with_gaps",
    GAPS + ", ws AS (SELECT i, j FROM gappy_weights UNION ALL SELECT id, id FROM h), g AS (SELECT i, sum(v) AS sv, count(*) AS k FROM ws JOIN h ON h.id = ws.j WHERE i IN (SELECT id FROM h) GROUP BY 1) SELECT i AS id, round((sv - m * k) / nullif(s * sqrt((n * k - k * k) / CAST(n - 1 AS DOUBLE)), 0), 6) AS gi FROM g, m",
    ("gappy_areas", "gappy_weights"),
)
def gi_star_with_gaps(t):
    return S.gi_star(t("gappy_areas"), t("gappy_weights")).select("id", F.round("gi", 6).alias("gi"))

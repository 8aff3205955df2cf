"""Deterministic sample views over the given tables, in SQL that Spark and DuckDB read alike.

``{name}`` stands for a table or an earlier view. Integer arithmetic only, so both engines see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hearthframe import importable_by_workers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def pick(expr: str, values: list[str | None]) -> str:
    """One of the values by a number from 0."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


_K = "o_orderkey"
_AMT = "CAST(floor(o_totalprice) AS BIGINT)"
_THOUSANDS = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING)"
_PTYPES = ["house", "apartment", "Land", "single room", "office", "flat"]
_BEDS = ["3 bedroom", "2 bdrm", "four bed", "1 bedroom", "", "5 bedrooms", "18 bedroom"]
_SIZES = ["12 decimals", "half an acre", "50x100 ft plot", "1.5 acres", "two plots", "180 sqm", "2,000 sq ft", "1 hectare", "100 by 100", "no size given", "0 decimals"]
_TENURE = ["private mailo land", "on kibanja, sale agreement only", "49 years lease title", "freehold land with ready title", "title in process", "customary land", "ready title", "nice location", "untitled"]
_FEATURES = [
    "self contained with boys quarters and parking",
    "unfurnished flat off the tarmac main road",
    "fully furnished apartment, swimming pool, generator",
    "real estate agent listing, walled and gated with cctv",
    "in a quiet estate with water tank and solar",
    "duplex with lake view, tiled, mortgage available",
    "shell house at roofing level, commercial shops near",
    "bungalow, negotiable, security guard daily",
]
_TERMS = ["6 months advance", "pay 3 months and 1 month deposit", "minimum of six months", "rent paid quarterly", "half year payment", "payable annually", "2 months deposit", "built 24 months ago", "contact the owner", "advance payment of 4 months"]

VIEWS: dict[str, str] = {
    # V1
    "listing_raw": f"""
        SELECT {_K} AS lid, {pick(f"{_K} % 3", ["alpha", "beta", "gamma"])} AS source, CAST({_K} % 9000 AS STRING) AS source_id,
          'https://alpha.example/' || CAST({_K} AS STRING) AS url, {pick(f"{_K} % 5", ["rent", "rent", "sale", "sale", None])} AS listing_type,
          {pick(f"({_K} + 1) % 6", _PTYPES)} AS property_type,
          {pick(f"{_K} % 7", _BEDS)} || ' ' || {pick(f"({_K} + 1) % 6", _PTYPES)} || ' in ' || n_name || CASE WHEN {_K} % 4 = 0 THEN ', ' || r_name ELSE '' END
            || ' for ' || {pick(f"{_K} % 5", ["rent", "rent", "sale", "sale", "sale"])} AS title,
          {pick(f"{_K} % 8", _FEATURES)} || '. ' || {pick(f"{_K} % 11", _SIZES)} || '. ' || {pick(f"{_K} % 9", _TENURE)} || '. ' || {pick(f"{_K} % 10", _TERMS)}
            || CASE WHEN {_K} % 13 = 0 THEN '. call 0772 123 456 or mail agent.' || CAST({_K} % 97 AS STRING) || '@mail.example.com' ELSE '' END AS description,
          CASE {_K} % 6 WHEN 0 THEN 'UGX ' || CAST({_AMT} * 10 AS STRING)
            WHEN 1 THEN 'Ugx ' || {_THOUSANDS} || ',' || lpad(CAST({_AMT} % 1000 AS STRING), 3, '0') || ',000/='
            WHEN 2 THEN {_THOUSANDS} || 'k' WHEN 3 THEN '$' || CAST({_AMT} AS STRING)
            WHEN 4 THEN 'USD ' || CAST({_AMT} AS STRING) || ' per month' ELSE 'price on request' END AS price_raw,
          {pick(f"{_K} % 4", [None, "UGX", "usd", "ugx"])} AS currency_raw,
          {pick(f"{_K} % 8", ["per month", "per year", "per week", None, "per night", "quarterly", "per plot", "per acre"])} AS price_period,
          n_name AS location_raw, n_name AS district_raw, r_name AS region_raw,
          {pick(f"{_K} % 9", ["3", "two", None, None, "1", None, "four", "20", None])} AS bedrooms_raw,
          {pick(f"{_K} % 5", ["2", None, "1", "520", None])} AS bathrooms_raw,
          {pick(f"{_K} % 10", [None, "0 Decimals", "15 decimals", None, "250", None, "0.25 acres", None, None, "9000 decimals"])} AS size_raw,
          {pick(f"{_K} % 10", [None, None, None, None, "sqm", None, None, None, None, None])} AS size_unit_raw,
          {pick(f"{_K} % 7", [None, "Private Mailo", "", None, "Freehold", None, None])} AS tenure_raw,
          {pick(f"{_K} % 6", [None, "Unfurnished", "Furnished", None, None, "furnished flat"])} AS furnishing_raw,
          'agent ' || CAST(o_custkey % 50 AS STRING) AS agent, n_nationkey AS nation, r_regionkey AS region_id, o_custkey AS custkey, o_totalprice AS amount0,
          CASE WHEN {_K} % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS listing_date, CAST(o_orderdate AS DATE) AS scraped_at
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    # V2
    "fx_month": """
        SELECT month, CAST(3000 + 10 * (i % 97) AS DOUBLE) AS rate FROM (
          SELECT DISTINCT substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS month,
            (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS i FROM {orders}) t WHERE i % 11 <> 0""",
    # V3
    "parish_income": """
        SELECT c_custkey AS parish, 50000 + 100 * abs(c_acctbal) AS income, CAST(20 + c_custkey % 400 AS DOUBLE) AS households,
          CAST(34 + 2 * r_regionkey AS DOUBLE) / 100 AS gini, r_name AS district, n_name AS subcounty, r_regionkey AS region_id, n_nationkey AS nation, CAST(3 + c_custkey % 4 AS DOUBLE) AS hh_size
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "index_listings": """
        SELECT o_orderkey AS lid, CASE WHEN o_orderkey % 5 < 2 THEN 'rent' ELSE 'sale' END AS listing_type, 0.5e0 * (o_orderkey % 6 + 1) AS bedrooms,
          CASE WHEN o_orderkey % 5 < 2 THEN o_totalprice END AS rent_month, CASE WHEN o_orderkey % 5 >= 2 THEN 100 * o_totalprice END AS price,
          CASE o_orderkey % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'apartment' ELSE 'land' END AS ptype, r_name AS district, n_name AS subcounty, o_custkey AS parish, o_orderdate AS listing_date
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # V4
    "points": "SELECT o_orderkey AS pid, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) AS x, CAST((o_orderkey * 104729) % 10009 AS DOUBLE) AS y, o_totalprice AS value FROM {orders}",
    # Points with unknown coordinates and values among them.
    "gappy_points": """
        SELECT pid, CASE WHEN pid % 11 = 0 THEN NULL ELSE x END AS x, CASE WHEN pid % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE y END AS y,
          CASE WHEN pid % 7 = 0 THEN NULL WHEN pid % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM {points}""",
    # V5
    "units": """
        SELECT n_nationkey AS unit, n_regionkey AS region_id, 2002.0 * (n_nationkey % 5) AS x0, 2002.0 * CAST(floor(n_nationkey / 5) AS INT) AS y0,
          2002.0 * (n_nationkey % 5) + 2002.0 AS x1, 2002.0 * CAST(floor(n_nationkey / 5) AS INT) + 2002.0 AS y1 FROM {nation}""",
    # Areas some of which have no value, one that neighbours all others, and one that neighbours none.
    "gappy_areas": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 2 THEN NULL WHEN n_nationkey = 9 THEN CAST('NaN' AS DOUBLE) ELSE n_nationkey * 1.5e0 + n_nationkey % 4 END AS v FROM {nation}",
    "gappy_weights": """
        SELECT a.n_nationkey AS i, b.n_nationkey AS j, 0.5e0 AS w FROM {nation} a JOIN {nation} b
          ON (a.n_nationkey = 1 AND b.n_nationkey <> 1) OR (a.n_nationkey > 1 AND a.n_nationkey < 24 AND b.n_nationkey BETWEEN a.n_nationkey + 1 AND a.n_nationkey + 2)""",
    # V6
    "poi": "SELECT s_suppkey AS poi, CAST((s_suppkey * 6151) % 10007 AS DOUBLE) AS px, CAST((s_suppkey * 3571) % 10009 AS DOUBLE) AS py, s_nationkey AS line FROM {supplier}",
    # V7
    "road_edges": """
        SELECT a AS src, CASE WHEN step = 1 THEN a + 1 ELSE a + 7 END AS dst, CAST(1 + (13 * a) % 9 AS DOUBLE) AS minutes, a % 4 AS kind
        FROM (SELECT s_suppkey AS a FROM {supplier}) s CROSS JOIN (SELECT 1 AS step UNION ALL SELECT 7 AS step) t""",
    # V8
    "snapshots": "SELECT event_id, user_id AS source_id, event_type AS source, ts AS scraped_at, value FROM {events}",
    # V9
    "panel": """
        SELECT o_orderkey AS row_id, n_nationkey AS point, CASE WHEN year(o_orderdate) < 1998 THEN 0 ELSE 1 END AS post, CASE WHEN n_regionkey < 2 THEN 1 ELSE 0 END AS treated,
          ln(o_totalprice) AS y, CAST(o_custkey % 7 AS DOUBLE) AS z, n_regionkey AS region_id
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # V10
    "monthly": "SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS month, avg(o_totalprice) AS value, count(*) AS n FROM {orders} GROUP BY 1",
    # V14
    "dwelling": """
        SELECT p_partkey AS did, p_size % 6 + 1 AS bedrooms, CAST(p_size AS DOUBLE) AS plot, avg(l_extendedprice) * 10000 AS price,
          CASE WHEN p_size % 3 = 0 THEN CAST(40 + p_size AS DOUBLE) END AS floor_m2, p_size % 25 AS unit, p_size % 2 AS f_pool, CAST(floor(p_size / 2) AS INT) % 2 AS f_gated, p_partkey % 2 AS f_furnished, p_type AS kind
        FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY ALL""",
}


def _needed(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


#: Rows a task of costly projections, at most about.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A table whose files make fewer scan tasks than there are cores, or than its rows ask for, dealt to as many tasks, for costly
    projections: compressed files hold millions of rows a split. Other tables are left as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wanted = cores * max(1, -(-df.count() // (TASK_ROWS * cores)))  # counted from the files' footers
    files = len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")))
    return df.repartition(wanted) if max(files, size // split) < wanted else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a sample view."""
    importable_by_workers(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    of = lambda n: spread(view(spark, sf_dir, n)) if (name, n) == ("listing_raw", "orders") else view(spark, sf_dir, n)
    return spark.sql(VIEWS[name], **{n: of(n) for n in dict.fromkeys(_needed(name))})


def with_views(*names: str) -> str:
    """A WITH clause that defines the views for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in _needed(name):
            add(n)
        order.append(name)

    for n in names:
        add(n)
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in order}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({plain[n]})" for n in order)

"""Page layouts, wide sheets and label units on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from hearthframe.operators import spatial as S
from hearthframe.sources import records as C


def test_archived_layouts(spark):
    texts = [
        (1, "QUICK SUMMARY Code: 9 Location: Kito District: North Price: Ugx 9m Category: Bungalow Size 25 Decimals Tenure Lease Status For sale Agent x DESCRIPTION calm, call 0772123456 Related"),
        (2, "A 2 bedroom flat for rent in Kito, near the lake PROPERTY SPECIFICATIONS Code: 7 Rooms: two Location: Kito hill PROPERTY DETAILS bright and new Email this"),
        (3, "nothing here"), (4, ""), (5, None), (6, "quick summary description "), (7, "PROPERTY SPECIFICATIONS Rooms: 3 " + "w " * 20_000),
    ]
    df = spark.createDataFrame(texts, "id int, t string").withColumn("p", C.archived_page(F.col("t"), ("Code", "Rooms", "Location")))
    got = {r["id"]: r["p"] for r in df.collect()}
    assert (got[1]["layout"], got[1]["type"], got[1]["price"], got[1]["rent"], got[1]["bedrooms"], got[1]["size"]) == ("summary", "Bungalow Sale", "Ugx 9m", None, None, "25 Decimals")
    assert "0772123456" not in got[1]["description"] and got[1]["description"].startswith("calm")
    assert got[2]["layout"] == "specifications" and got[2]["fields"] == {"Code": "7", "Rooms": "two", "Location": "Kito hill"}
    assert got[2]["description"] == "bright and new" and got[2]["headline"] == "2 bedroom flat for rent in Kito"
    assert got[5] is None and all(got[i]["layout"] is None and got[i]["description"] is None for i in (3, 4))
    assert got[6]["layout"] == "summary" and got[6]["description"] is None and got[7]["layout"] == "specifications"


def test_detail_pages(spark):
    pages = [(1, ["x, code: 12, y", "QUICK SUMMARY", "Price:", "$ 900 /m", "Price", "no", "Status", "To let", "DESCRIPTION", "one", "● more"]), (2, ["QUICK SUMMARY", "BedRooms", "many"]), (3, ["nothing"]), (4, []), (5, None)]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(pages, "id int, lines array<string>").select("id", C.detail_page(F.col("lines")).alias("p")).collect()}
    assert (got[1]["title"], got[1]["price_raw"], got[1]["currency_raw"], got[1]["price_period"], got[1]["listing_type"], got[1]["description"]) == ("x", "$ 900 /m", "USD", "per month", None, "one")
    assert got[2]["bedrooms_raw"] == "many" and got[2]["description"] == "" and got[2]["title"] is None
    assert got[3] is None and got[4] is None and got[5] is None


def test_wide_sheets(spark):
    rows = [(1, "2015/16", "Q1", "100", "7"), (2, None, "Q2", "101.23456", None), (3, None, None, "note", None), (4, None, "Q3", "x", "8"), (5, None, "Q4", "103", "9"), (6, "2016/17", "Q1", "104", "10")]
    got = {(r["period_start"], r["area"]): (r["fy"], r["value"]) for r in C.wide_quarters(spark.createDataFrame(rows, "n int, fy string, q string, a string, b string"), "n", "fy", "q", ["a", "b"]).collect()}
    days = [dt.date(2015, 7, 1), dt.date(2015, 10, 1), dt.date(2016, 1, 1), dt.date(2016, 4, 1), dt.date(2016, 7, 1)]
    assert set(got) == {(d, a) for d in days for a in "ab"}
    assert [got[d, "a"] for d in days] == [("2015/16", 100.0), ("2015/16", 101.235), ("2015/16", None), ("2015/16", 103.0), ("2016/17", 104.0)]


def test_label_units_and_counts(spark):
    for values, want in (([2e9] * 4, (1e9, "billion")), ([5.0, 2000.0, 3000.0, 2e9], (1e6, "million")), ([1.0], (1.0, "")), ([], (1.0, ""))):
        assert tuple(S.scaled_unit(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()[0]) == want
    df = spark.createDataFrame([("HH",), ("HH",), (None,), ("zz",)], "l string")
    assert {r["l"]: r["n"] for r in S.label_counts(df, "l", ["HH", "LL"]).collect()} == {"HH": 2, "LL": 0}


def _named(df, pattern):
    """How often an expression stands in the optimized plan, as it is worked out each time."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_a_summary_block_is_cut_out_once_a_page(spark):
    spark.conf.set("spark.sql.maxToStringFields", 10_000)
    lines = spark.createDataFrame([(["QUICK SUMMARY", "Code:", "7", "Status:", "For Sale"],), (["no block"],), (None,)], "l array<string>")
    got = lines.select(C.detail_page(F.col("l")).alias("p"))
    assert [r.p and (r.p.source_id, r.p.listing_type, r.p.bedrooms_raw) for r in got.collect()] == [("7", "sale", None), None, None]
    assert _named(got, "QUICK SUMMARY") <= 4


def test_an_archived_page_is_matched_once(spark):
    spark.conf.set("spark.sql.maxToStringFields", 10_000)
    text = "QUICK SUMMARY Code: 1 Location: here Price: 5 Status For sale Agent x DESCRIPTION fine Tell a friend"
    got = spark.createDataFrame([(text,), ("neither",), (None,)], "t string").select(C.archived_page(F.col("t"), ("Location",)).alias("p"))
    assert [r.p and r.p.layout for r in got.collect()] == ["summary", None, None]
    assert _named(got, "regexp_extract(t#") <= 6

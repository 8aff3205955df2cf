"""Composite similarity, tiers of name matching, outlines, fallback weights, sinks and small finance tables."""

import pytest
from pyspark.sql import functions as F

from hearthframe.operators import duplicates as U
from hearthframe.operators import finance as N
from hearthframe.operators import places as P
from hearthframe.operators import spatial as S


def test_composite_similarity():
    assert U.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert U.weighted_ratio("this is a word", "THIS IS A WORD") == pytest.approx(100 * 3 / 14)
    assert U.window_ratio("this is a test", "this is a test!") == 100 and U.window_ratio("", "a") == 0 and U.window_ratio("", "") == 100
    assert U.token_set_ratio("bear was fuzzy", "fuzzy fuzzy was a bear") == 100 and U.token_set_ratio("", "a") == 0
    assert U.weighted_ratio("", "abc") == 0 and U.weighted_ratio("ntinda", "ntinda") == 100
    assert U.weighted_ratio("kiwatulle", "kiwatule") == pytest.approx(100 * 16 / 17)
    for a, b in (("kyanja ring", "ring kyanja hill top estate"), ("abcd", "zzabxcdzz"), ("one two", "two three")):
        assert U.weighted_ratio(a, b) == pytest.approx(U.weighted_ratio(b, a))

    def plain(a, b):  # every run of the longer text
        a, b = sorted((a, b), key=len)
        ends = [(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if j - i == len(a) or (j - i < len(a) and (i == 0 or j == len(b)))]
        return max(U.indel_ratio(a, b[i:j]) for i, j in ends)

    assert U.window_ratio("abcd", "zzabxcdzz") == plain("abcd", "zzabxcdzz") and U.window_ratio("dzz", "zzabxcdzzq") == 100


def test_fuzzy_tier_comes_last(spark):
    g = spark.createDataFrame([(1, "kiwatule", "Kiwatule"), (2, "ntinda", "Ntinda"), (3, "muyenga", "Muyenga"), (4, "ntinda2", "Ntinda")], "ord int, place string, name string")
    x = spark.createDataFrame([(1, "Kiwatulle"), (2, "near Muyengaa road, Kampala"), (3, "house in Ntinda"), (4, "Ntinda"), (5, "zzz"), (6, None), (7, ""), (8, "Bukoto hill")], "tid int, text string")
    got = sorted((r["tid"], r["place"], r["method"]) for r in U.match_place_fuzzy(x, g, "text", "tid").collect())
    assert got == [(1, "kiwatule", "lookup_exact"), (2, "muyenga", "lookup_fuzzy"), (3, "ntinda2", "lookup_contains"), (4, "ntinda2", "lookup_exact"), (5, None, None), (6, None, None), (7, None, None), (8, None, None)]
    assert U.match_place_fuzzy(x.filter("tid = 5"), g.limit(0), "text", "tid").collect()[0]["place"] is None


def test_pool_of_like_subcounties(spark):
    names = spark.createDataFrame([("a", "North", "Upper Town", "Kisota"), ("b", "North", "Lower Side", "Kisotta"), ("c", "North", "Lower Side", "Bweya"), ("d", "South", "Upper Town", "Kisota")], "nid string, district string, subcounty string, parish string")
    x = spark.createDataFrame([(1, "north", "upper towns", "Kisota"), (2, "North", "Lower Side", "Kisota"), (3, "North", "elsewhere", "Bweyaa"), (4, "North", "Upper Town", "Bweya"), (5, "East", "Upper Town", "Kisota"), (6, None, "Upper Town", "Kisota"), (7, "South", None, "Kisota")], "tid int, district string, subcounty string, parish string")
    assert sorted((r["tid"], r["nid"]) for r in U.match_in_pool(x, names, "tid").collect()) == [(1, "a"), (2, "b"), (3, "c"), (7, "d")]


def test_neighbouring_areas_of_one_name(spark):
    areas = spark.createDataFrame([("Kito", "north", 0.0, 32.0), ("Kito", "south", 0.01, 32.02), ("Buso", "north", 0.0, 32.0), ("Buso", "south", 1.0, 32.0), ("Lone", "north", 2.0, 33.0)], "area string, district string, lat double, lon double")
    x = spark.createDataFrame([(1, "Kito, town", None), (2, "Kito", "South "), (3, "Buso", None), (4, "Buso", "north"), (5, "xx, Lone", "east"), (6, None, None)], "tid int, text string, district string")
    got = {r["tid"]: (r["area"], round(r["lat"], 6), round(r["lon"], 6)) for r in U.match_area_point(x, areas, "tid").collect()}
    assert got == {1: ("Kito", 0.005, 32.01), 2: ("Kito", 0.01, 32.02), 4: ("Buso", 0.0, 32.0), 5: ("Lone", 2.0, 33.0)}
    assert {r["tid"] for r in U.match_area(x, areas, "tid").collect()} == {2, 4, 5}


def box(x, y, closed=False):
    ring = [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    return ring + ring[:1] if closed else ring


def test_outline_of_parts(spark):
    parts = spark.createDataFrame([("l", box(0.0, 0.0)), ("l", box(1.0, 0.0, True)), ("l", box(0.0, 1.0)[::-1]), ("one", box(5.0, 5.0)), ("none", None), ("none", [])], "unit string, ring array<struct<x:double,y:double>>")
    rows = S.dissolve(parts, "unit").collect()
    length = lambda u: sum(abs(r["bx"] - r["ax"]) + abs(r["by"] - r["ay"]) for r in rows if r["unit"] == u)
    assert length("l") == 8 and length("one") == 4 and length("none") == 0
    assert (1.0, 0.0, 1.0, 1.0) not in {tuple(r)[1:] for r in rows if r["unit"] == "l"}
    names = spark.createDataFrame([(" WAKISO ", "kira town"), ("gulu", "x")], "d string, s string")
    assert [tuple(r) for r in S.prepared_units(names, ["d", "s"], "d", ["Wakiso"]).collect()] == [("Wakiso", "Kira Town")]


def test_islands_take_nearest_centres(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 2.0, 1.0), (3, 9.0, 9.0, 10.0, 10.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda w: {(r["i"], r["j"]) for r in w.collect()}
    assert pairs(S.contiguity_weights(boxes.filter("id < 3"), 1)) == {(1, 2), (2, 1)} and pairs(S.contiguity_weights(boxes, 1)) == {(1, 2), (2, 1), (3, 2)}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.23456, "a"), (2, None, None)], "id int, v double, s string")
    P.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == [("1", "1.2346", "a"), ("2", None, None)]
    P.write_json(df, str(tmp_path / "j"))
    assert sorted((r["id"], r["v"], r["s"]) for r in spark.read.schema("id int, v double, s string").json(str(tmp_path / "j")).collect()) == [(1, 1.23456, "a"), (2, None, None)]
    P.write_points(spark.createDataFrame([(1, 2.0, 3.5)], "id int, x double, y double"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect()[0]["wkt"] == "POINT (2.0 3.5)"


def test_supply_and_visibility_of_thin_groups(spark):
    rows = [("a", 10.0, 100.0, 1.0)] * 3 + [("a", 25.0, 300.0, 2.0)] * 2 + [("b", None, 100.0, 1.0), (None, 70.0, 900.0, 3.0), ("b", 0.0, 500.0, None)]
    r = spark.createDataFrame(rows, "area string, m double, rent_month double, bedrooms double")
    local = spark.createDataFrame([("a", 50.0)], "area string, local_budget double")
    got = {(x["kind"], x["name"]): (x["n"], x["within_budget"], x["within_local"]) for x in N.supply_by_group(r, "area", "m", 200.0, local, min_n=2).collect()}
    assert got == {("area", "a"): (5, 0.6, 0.0), ("area", "b"): (2, 0.5, 0.5), ("time", "<20"): (3, 1.0, 1.0), ("time", "20-30"): (2, 0.0, 0.0), ("all", None): (8, 0.5, 0.5)}
    v = N.visibility(spark.createDataFrame([("a", "rent"), ("a", "sale")], "area string, listing_type string"), spark.createDataFrame([("a", 500.0), ("b", 100.0)], "area string, households double"), spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.5, 0.4)], "area string, share_rented double, share_one_room double"), "area")
    assert {x["area"]: (x["listings"], x["per_1000_hh"], x["renters_per_listing"]) for x in v.collect()} == {"a": (2, 4.0, 250.0), "b": (0, 0.0, None)}
    assert v.filter(F.col("single_room_renters").isNull()).isEmpty()

"""Raw layers from files: columns by name, quoted newlines, rows that are none, XML extracts."""

from hearthframe.sources import records as S


def test_csv_snapshots_of_several_portals(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "a.csv").write_text('source,source_id,title,lat\nalpha,1,"two\nlines, and ""quotes""",0.5\nalpha,2,short\nalpha,3,plain,nan?\nalpha,4,five,1.5,extra\n')
    (tmp_path / "two" / "b.csv").write_text("﻿title,Unknown,source,source_id\nplace,x,beta,7\n,,beta,8\n")
    (tmp_path / "two" / "empty.csv").write_text("")
    (tmp_path / "two" / "header.csv").write_text("title,source\n")
    got = sorted((r["source"], r["source_id"], r["title"], r["lat"]) for r in S.read_raw(spark, f"{tmp_path}/*").collect())
    assert got == [("alpha", "1", 'two\nlines, and "quotes"', 0.5), ("alpha", "3", "plain", None), ("beta", "7", "place", None), ("beta", "8", None, None)]
    bad = S.bad_rows(spark, f"{tmp_path}/*").collect()
    assert sorted(r["_bad"] for r in bad) == ["alpha,2,short", "alpha,4,five,1.5,extra"] and all(r["_file"].endswith("a.csv") for r in bad)
    order = [r["source_id"] for r in S.scan_csv(spark, f"{tmp_path}/one").orderBy("_file", "_at").collect()]
    assert order[:1] == ["1"] and order[2] == "3"
    assert S.read_raw(spark, f"{tmp_path}/nothing*").count() == 0 and S.read_raw(spark, f"{tmp_path}/nothing*").columns == list(S.RAW_COLUMNS)


def test_extracts_as_xml_and_as_csv(spark, tmp_path):
    rows = [("11", "House & yard", "UGX 5m", "For Sale"), ("12", "Flat", None, "for RENT now"), ("13", "Plot", "1", None)]
    esc = lambda s: s.replace("&", "&amp;")
    cell = lambda k, v: f"<{k}>{esc(v)}</{k}>" if v is not None else ""
    body = "".join("<row>" + "".join(cell(k, v) for k, v in zip(("HouseCode", "Title", "Price", "Status"), r)) + "<Odd>1</Odd></row>" for r in rows)
    (tmp_path / "e.xml").write_text(f"<data>{body}</data>")
    (tmp_path / "e.csv").write_text("HouseCode,Odd,Title,Price,Status\n" + "".join(f"{a},1,{b},{c or ''},{d or ''}\n" for a, b, c, d in rows))
    want = [("red", "11", "House & yard", "UGX 5m", "sale"), ("red", "12", "Flat", None, "rent"), ("red", "13", "Plot", "1", None)]
    for name in ("e.xml", "e.csv"):
        got = S.read_extract_files(spark, "red", f"{tmp_path}/{name}")
        assert sorted((r["source"], r["source_id"], r["title"], r["price_raw"], r["listing_type"]) for r in got.collect()) == want
        assert got.columns == list(S.RAW_COLUMNS)

"""Every query with SQL gives that SQL's rows; the others give rows."""

import os

import duckdb
import pytest

from hearthframe.plans import catalogue
from hearthframe.sources.samples import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(rows):
    plain = lambda v: "~" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in rows)


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-5 * max(1.0, abs(float(a)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = cells(df.select(*columns).collect()), cells(got.fetchall())
    assert len(mine) == len(theirs)
    assert all(close(x, y) for r, s in zip(mine, theirs) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert all(any(r[c] is not None for r in rows) for c in df.columns)

"""The driver contract."""

import __spark_entry__ as entry


def test_names():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    assert all(callable(f) for f in known.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "rai" in df.columns

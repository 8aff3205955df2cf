"""Work that is done once, however often its rows are met, and in enough tasks."""

from pyspark.sql import functions as F

from hearthframe.operators import models as M
from hearthframe.sources import samples


def test_checks_read_their_panel_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            read.add(len(f))
            yield f

    n = 600
    rows = spark.range(n).select("id", (F.col("id") % 12).alias("point"), (F.col("id") % 5 % 2).cast("int").alias("post"), (F.col("id") * 37 % 101 / 9).alias("y"), (F.col("id") % 12 * 3).cast("double").alias("minutes"))
    got = M.did_checks(rows.mapInPandas(seen, rows.schema), "minutes", draws=9)
    assert len(got) == 6 and all(r["n"] == n for r in got if r["check"] != "trimmed") and read.value == n


def test_checks_hold_no_period_in_a_task(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = [(i % 3, float(v)) for i, v in enumerate(rng.integers(0, 40, 400))] + [(0, None), (1, float("nan")), (7, 2.5), (8, None)]
    df = spark.createDataFrame(rows, "post int, y double")
    got = {r["post"]: (r["lo"], r["hi"]) for r in M.group_quantiles(df, "post", "y", {"lo": 0.05, "hi": 0.9}).collect()}
    known = {g: [v for k, v in rows if k == g and v is not None and v == v] for g in (0, 1, 2, 7)}
    assert got == {g: tuple(np.percentile(v, [5, 90])) for g, v in known.items()}
    joined = []
    monkeypatch.setattr(M.F, "percentile", lambda *a: joined.append(a))  # holds all of a group's values in one task
    n = 400
    panel = spark.range(n).select("id", (F.col("id") % 8).alias("point"), (F.col("id") % 5 % 2).cast("int").alias("post"), (F.col("id") * 37 % 101 / 9).alias("y"), (F.col("id") % 8 * 3).cast("double").alias("minutes"))
    r = {x["check"]: x for x in M.did_checks(panel, "minutes", draws=0)}["trimmed"]
    d = panel.toPandas()
    lo, hi = (d.groupby("post")["y"].transform(lambda v, q=q: np.percentile(v, q)) for q in (5, 95))
    d = d[(d["y"] >= lo) & (d["y"] <= hi)]
    x = np.c_[(d["minutes"] <= 15) * d["post"], d["post"]].astype(float)
    x, y = (v - v.groupby(d["point"].to_numpy()).transform("mean") for v in (pd.DataFrame(x), d["y"].reset_index(drop=True)))
    assert not joined and r["n"] == len(d) and abs(r["coef"] - np.linalg.lstsq(x.to_numpy(), y.to_numpy(), rcond=None)[0][0]) < 1e-9


def test_costly_rows_are_dealt_by_number(spark, tmp_path):
    spark.range(0, 900_000, 1, 1).write.parquet(str(tmp_path / "t"))
    sizes = [len(p) for p in samples.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.glom().collect()]
    assert sum(sizes) == 900_000 and len(sizes) == 12 and max(sizes) <= 76_000

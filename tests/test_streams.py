"""State kept by Spark between runs: restarts, late rows, repeats, null keys."""

import datetime as dt

from hearthframe.streaming import snapshots as N


def when(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_repeats_and_late_rows_within_the_watermark(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, at timestamp, v int").schema
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    (tmp_path / "in").mkdir()

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = N.stream_unrepeated(N.file_stream(spark, folder, "*.parquet", schema), ["k"], "at", "2 days", root).collect()
        return sorted((r["k"], r["v"]) for r in got)

    assert run([("a", when(10), 1), ("b", when(10), 1)]) == [("a", 1), ("b", 1)]
    assert run([("a", when(10, 5), 2), ("c", when(11), 1)]) == [("a", 1), ("b", 1), ("c", 1)]  # a repeat, after a restart
    first = run([("d", when(20), 1)])  # the watermark goes on to the 18th
    assert run([("e", when(12), 1), ("f", when(19), 1), ("a", when(19), 3)]) == sorted([*first, ("f", 1), ("a", 3)])  # too late; in time; long forgotten


def test_restart_keeps_state_and_a_run_without_root_leaves_nothing(spark, tmp_path):
    import os

    schema = spark.createDataFrame([], "k string, at int, v double").schema
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    (tmp_path / "in").mkdir()
    source = lambda: N.file_stream(spark, folder, "*.parquet", schema)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([("a", 5, 1.0), ("a", 3, 2.0), (None, 1, 0.0)])
    rows = lambda d: {r["k"]: (r["at"], r["v"]) for r in d.collect()}
    assert rows(N.stream_latest(source(), ["k"], ["at"], root)) == {"a": (5, 1.0), None: (1, 0.0)}
    put([("a", 4, 9.0), (None, 2, 7.0)])  # an older row of a does not replace it
    assert rows(N.stream_latest(source(), ["k"], ["at"], root)) == {"a": (5, 1.0), None: (2, 7.0)}
    assert rows(N.stream_latest(source(), ["k"], ["at"], root)) == {"a": (5, 1.0), None: (2, 7.0)}  # nothing new
    streams = os.path.join(N.shared_folder(spark).removeprefix("file:"), "streams")
    before = set(os.listdir(streams)) if os.path.isdir(streams) else set()
    seen = {r["k"]: (r["first_seen"], r["n_postings"]) for r in N.stream_first_seen(source(), ["k"], "at").collect()}
    assert seen == {"a": (3, 3), None: (1, 2)} and (set(os.listdir(streams)) if os.path.isdir(streams) else set()) == before

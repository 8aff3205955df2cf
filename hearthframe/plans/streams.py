"""Streaming forms of the snapshot layer, run over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe.functions import text as T
from hearthframe.streaming import snapshots as S

from .registry import ORACLE_SQL, QUERIES


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return S.file_stream(spark, sf_dir, "events.parquet", schema)


def stream_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.stream_latest(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select("user_id", "event_type", "event_id")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream_first_seen(_events(spark, sf_dir), ["user_id"], "event_id").select("user_id", "first_seen", "n_postings")


def stream_unrepeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All there is comes as one batch here, in which a key is given out once."""
    events = _events(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return S.stream_unrepeated(events, ["user_id", "event_type"], "ts", "30 days").select("user_id", "event_type")


def stream_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat(F.lit("UGX "), F.col("event_id").cast("string"), F.lit("k per month"))
    project = lambda df: df.select("event_id", T.amount(price).alias("amount"), T.rent_factor(price).alias("factor"))
    return S.stream_project(_events(spark, sf_dir), project)


QUERIES |= {"stream_latest_snapshot": stream_latest_snapshot, "stream_first_seen": stream_first_seen, "stream_cleaning": stream_cleaning, "stream_unrepeated": stream_unrepeated}
ORACLE_SQL |= {
    "stream_unrepeated": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_latest_snapshot": "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "stream_first_seen": "SELECT user_id, min(event_id) AS first_seen, CAST(count(*) AS BIGINT) AS n_postings FROM events GROUP BY 1",
    "stream_cleaning": "SELECT event_id, CAST(event_id AS DOUBLE) * 1000 AS amount, 1.0e0 AS factor FROM events",
}

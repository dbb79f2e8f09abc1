"""Streaming queries: each drains a stream over a table and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans.registry import Registry
from quillstone.sources.tables import path_of
from quillstone.streaming import pipelines as P

R = Registry()


@R.add("stm30_stream_tally", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_tally(spark, d):
    return P.drain(P.tally(P.open_stream(spark, path_of(d, "events")), "ts", ["event_type"]), "tally", "complete")


@R.add("stm26_stream_claims", "SELECT DISTINCT user_id, event_type FROM events")
def stream_claims(spark, d):
    """The first event of each user and type (all events lie within the expiry)."""
    return P.drain(P.claimed_once(P.open_stream(spark, path_of(d, "events")).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type"), "claims")


@R.add("stm13_stream_alert_hits", "SELECT DISTINCT user_id AS alert_id, event_id % 50 AS doc_id FROM events WHERE event_type = 'view'")
def stream_hits(spark, d):
    e = P.open_stream(spark, path_of(d, "events")).where("event_type = 'view'")
    hits = e.select(F.col("user_id").alias("alert_id"), (F.col("event_id") % 50).alias("doc_id"), F.col("ts").cast("timestamp").alias("at"))
    return P.drain(P.alert_hits(hits, "alert_id", "doc_id", "at"), "hits").select("alert_id", "doc_id")

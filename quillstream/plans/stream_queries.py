"""Streaming operators over ``events``, which arrive out of order; each must give what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans import event_queries as E
from quillstream.session import table
from quillstream.streaming import ordered, stateful
from quillstream.streaming.replay import last_rows, replay

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("stream_look_back", f"SELECT user_id, event_type, event_id, duplicate FROM ({E.ORACLES['greedy_lookback_dedup']})")
def stream_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replay(_events(spark, sf_dir), "ts", "event_id", lambda s: ordered.look_back(s, ["user_id", "event_type"], "ts", "event_id", 48 * 60))
    return done.select("user_id", "event_type", "event_id", "duplicate")


@query("stream_alerts", E.ORACLES["health_alerts"])
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type").isin("error", "view", "click")
    done = replay(_events(spark, sf_dir), "ts", "event_id", lambda s: ordered.alerts(s, ["user_id"], "ts", "event_id", F.coalesce(bad, F.lit(False))))
    return done.select("user_id", "event_id", "kind")


@query("stream_feedback", E.ORACLES["feedback_toggle_fold"])
def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click is delivered twice; the labels after the last one of each item and operator."""
    clicks = _events(spark, sf_dir).where("event_type <> 'purchase'").select("user_id", (F.col("event_id") % 97).alias("item"), "ts", "event_id", E._label().alias("label"), F.array().cast("array<string>").alias("reasons"))
    done = replay(clicks.unionByName(clicks), "ts", "event_id", lambda s: ordered.feedback(s, ["item", "user_id"], "ts", "event_id", "label", "reasons"))
    return last_rows(done, ["item", "user_id"], ["ts", "event_id", "counted"]).select("item", "user_id", "active_labels")


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replay(_events(spark, sf_dir), "ts", "event_type", lambda s: stateful.hourly_counts(s, "ts", "event_type"))
    return done.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("stream_fresh_items", "SELECT event_id % 500 AS item, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id, event_type FROM events WHERE ts IS NOT NULL) GROUP BY ALL")
def stream_fresh_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are delivered twice count once."""
    rows = _events(spark, sf_dir)
    done = replay(rows.unionByName(rows), "ts", "event_id", lambda s: stateful.fresh_items(s, ["event_id"], "ts", "2 hours"))
    return done.groupBy((F.col("event_id") % 500).alias("item"), "event_type").agg(F.count("*").alias("n"))

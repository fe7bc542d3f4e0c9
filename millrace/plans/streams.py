"""Queries over events: windows, sessions, and a stream run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import half_up
from millrace.session import new_path, table
from millrace.sources.sinks import committed
from millrace.streaming.incremental import file_stream, sessions, tumbling, upsert_stream


def event_days(spark: SparkSession, root: str) -> DataFrame:
    """Tumbling days per type (beyond the reference: it has no windows)."""
    d = tumbling(table(spark, root, "events", "ts", "event_type", "value"), "ts", "1 day", "2 hours", ["event_type"])
    return d.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", half_up(F.col("value"), 2).alias("value"))


def user_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions per user closed by an hour's gap: how many, and the longest in events."""
    s = sessions(table(spark, root, "events", "ts", "user_id"), "ts", "user_id", "1 hour")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def streamed_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Events streamed from their files into one latest row per user, run to the end."""
    out, check = new_path(spark, "upsert"), new_path(spark, "offsets")
    source = table(spark, root, "events")
    stream = file_stream(spark, f"{root}/events.parquet*", source.schema).select("user_id", "ts", "event_id", "event_type")
    upsert_stream(stream, out, ["user_id"], ["ts", "event_id"], check).awaitTermination()
    return committed(spark, out).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (event_days, user_sessions, streamed_upsert)}
SQL = {
    "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(sum(value) * 100.0 + 0.5) / 100.0 AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1",
    "streamed_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1",
}

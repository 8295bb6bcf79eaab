"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators.stored import shared_folder
from lectern.plans.registry import Tables, query
from lectern.streaming import events as st


def _path(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/lectern/{name}-{uuid.uuid4().hex}"


@query("stream_ingest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_ingest(t: Tables):
    stream = st.event_stream(t.spark, t.sf_dir)
    return st.ingest(stream, _path(t, "ingest"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "props"]).select("user_id", "event_type", "event_id")


@query("stream_window_counts", "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_window_counts(t: Tables):
    return st.run_to_table(st.windowed_counts(st.event_stream(t.spark, t.sf_dir), "ts", "1 day", "1 hour", "event_type"), _path(t, "windows"))


@query("stream_sessions", "WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND ts - p <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM g WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(t: Tables):
    return st.run_to_table(st.gap_sessions(st.event_stream(t.spark, t.sf_dir), "ts", "30 minutes", "1 hour", "user_id"), _path(t, "sessions"))


@query("rate_limited_calls", "SELECT event_id, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_limited_calls(t: Tables):
    return st.limited(t.events, ["event_type"], "ts", 3600, 2, "event_id").select("event_id", "allowed")


@query("incremental_sync", "SELECT event_id FROM events LEFT JOIN (SELECT DISTINCT user_id, TIMESTAMP '2024-01-20' AS c FROM events WHERE user_id % 2 = 0) USING (user_id) WHERE c IS NULL OR ts > c")
def incremental_sync(t: Tables):
    cursor = t.events.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("last_sync_at", F.lit("2024-01-20").cast("timestamp_ntz"))
    return st.since_cursor(t.events, cursor, "user_id", "ts", F.lit("2024-02-01").cast("timestamp_ntz"))[0].select("event_id")


@query("usage_ledger", "SELECT CAST(ts AS DATE) AS day, event_type AS feature, CAST(sum(floor(value)) AS BIGINT) AS amount FROM events GROUP BY 1, 2")
def usage_ledger(t: Tables):
    stream = st.event_stream(t.spark, t.sf_dir).select(F.to_date("ts").alias("day"), F.col("event_type").alias("feature"), F.floor("value").alias("amount"))
    return st.summed(stream, _path(t, "ledger"), ["day", "feature"], "amount")

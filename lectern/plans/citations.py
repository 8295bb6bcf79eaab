"""Queries over citations, schedules and timed segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import segments as sg
from lectern.functions import time as tm
from lectern.operators import citations as op
from lectern.plans.registry import Tables, query

_DOCS = "SELECT p_partkey AS k, p_partkey || ' ' || p_name AS title, p_brand AS channel FROM part"


def _documents(t: Tables):
    k = F.col("p_partkey")
    video = F.concat(F.lit("abcde"), F.lpad(k.cast("string"), 6, "0"))
    return t.part.select(k.alias("document_id"), video.alias("video_id"), F.concat(F.lit("https://www.site.example/d/"), k.cast("string"), F.lit("/")).alias("url"), F.concat_ws(" ", k, "p_name").alias("title"), F.col("p_brand").alias("channel"))


def _references(t: Tables):
    """One reference per order: by video, by address, by an address that misses, by title, by nothing."""
    k, kind = F.col("k"), F.col("o_orderkey") % 5
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") + 1).alias("k")).join(t.part.select(F.col("p_partkey").alias("k"), "p_name"), "k", "left")
    url = F.when(kind == 0, F.concat(F.lit("https://y.example/watch?v=abcde"), F.lpad(k.cast("string"), 6, "0"))).when(kind == 1, F.concat(F.lit("http://site.example/d/"), k.cast("string"), F.lit("#x"))).when(kind == 2, F.lit("http://elsewhere.example/"))
    context = F.when(kind == 3, F.concat(F.lit("as said in "), F.concat_ws(" ", k, "p_name"), F.lit(" of late")))
    return rows.select(F.col("o_orderkey").alias("ref_id"), url.alias("url"), context.alias("context"), F.lit("no channel").alias("channel"))


@query("resolved_citations", f"WITH d AS ({_DOCS}), r AS (SELECT o_orderkey AS ref_id, o_custkey + 1 AS k, o_orderkey % 5 AS kind FROM orders) SELECT ref_id, CASE WHEN kind IN (0, 1, 3) THEN d.k END AS document_id, CASE WHEN d.k IS NULL THEN NULL WHEN kind = 0 THEN 'video' WHEN kind = 1 THEN 'url' WHEN kind = 3 THEN 'title' END AS resolved_by FROM r LEFT JOIN d ON r.k = d.k")
def resolved_citations(t: Tables):
    return op.resolved(_references(t), _documents(t))


@query("cited_documents", "SELECT o_orderkey AS ref_id, p_partkey AS document_id FROM orders JOIN part ON p_partkey = o_custkey + 1 WHERE o_orderkey % 5 = 0")
def cited_documents(t: Tables):
    return op.cited_documents(_references(t), _documents(t))


@query("references_in_scope", "SELECT o_orderkey, document_id FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS document_id FROM orders) WHERE document_id IS NULL OR document_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def references_in_scope(t: Tables):
    refs = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("document_id"))
    return op.in_scope(refs, t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"))).select("o_orderkey", "document_id")


@query("verified_sources", "SELECT event_id, 'x [Source: View] y ' || CASE WHEN event_type IN ('view', 'click') THEN '[Source: ' || event_type || ']' ELSE '[Source: unverified]' END AS answer FROM events")
def verified_sources(t: Tables):
    answer = F.concat(F.lit("x [Source: View] y [Source: "), F.col("event_type"), F.lit("]"))
    return t.events.select("event_id", op.without_unknown(answer, F.array(F.lit("VIEW"), F.lit("click"))).alias("answer"))


@query("history_hits", "SELECT user_id AS exchange_id, event_id AS id, value AS distance FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1 ORDER BY value, event_id LIMIT 5")
def history_hits(t: Tables):
    return op.history_hits(t.events.select(F.col("user_id").alias("exchange_id"), F.col("event_id").alias("id"), F.col("value").alias("distance")))


@query("period_bounds", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH AS next_month, CAST(floor(epoch(ts) / 900) AS BIGINT) AS slot FROM events")
def period_bounds(t: Tables):
    return t.events.select("event_id", tm.period_start("ts", "day").alias("day"), tm.period_start("ts", "month").alias("month"), tm.next_period("ts", "month").alias("next_month"), tm.fixed_window("ts", 900).alias("slot"))


@query("next_runs", "SELECT event_id, CASE WHEN ts < date_trunc('day', ts) + INTERVAL 450 MINUTE THEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 450 MINUTE ELSE date_trunc('day', ts)::TIMESTAMP + INTERVAL 1890 MINUTE END AS next_run FROM events")
def next_runs(t: Tables):
    none = F.lit(None).cast("int")
    return t.events.select("event_id", tm.next_run("ts", F.lit("daily"), F.lit(7), F.lit(30), none, none, F.lit("UTC")).alias("next_run"))


@query("segment_chunks")
def segment_chunks(t: Tables):
    part = F.struct(F.col("turn").cast("double").alias("start"), "text", F.lit(1.0).alias("duration"), F.col("role").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("ref"), F.lit(False).alias("atomic"))
    talks = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("segments"))
    return sg.chunk_segments(talks, "conv_id", "segments")

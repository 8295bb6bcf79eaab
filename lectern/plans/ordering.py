"""Queries over windows and order-dependent picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ordering as op
from lectern.plans.registry import Tables, query


@query("sessions_gap", "WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND ts - p <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS started_at, max(ts) AS ended_at FROM s GROUP BY 1, 2")
def sessions_gap(t: Tables):
    s = op.gap_sessions(t.events, ["user_id"], "ts", 30, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


@query("capped_turns", "WITH RECURSIVE r AS (SELECT user_id % 10 AS chat, event_type AS sender, ts, length(props) AS n, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, n AS chars, 1 AS turn FROM r WHERE i = 1 UNION ALL SELECT r.chat, r.sender, r.ts, r.n, r.i, CASE WHEN r.sender <> g.sender OR r.ts - g.ts > INTERVAL 120 MINUTE OR g.chars + 1 + r.n > 30 THEN r.n ELSE g.chars + 1 + r.n END, CASE WHEN r.sender <> g.sender OR r.ts - g.ts > INTERVAL 120 MINUTE OR g.chars + 1 + r.n > 30 THEN turn + 1 ELSE turn END FROM g JOIN r ON r.chat = g.chat AND r.i = g.i + 1) SELECT chat, min(sender) AS sender, min(ts) AS started_at, count(*) AS messages, CAST(max(chars) AS INT) AS chars FROM g GROUP BY chat, turn")
def capped_turns(t: Tables):
    rows = t.events.select((F.col("user_id") % 10).alias("chat"), F.col("event_type").alias("sender"), "ts", F.col("props").alias("text"), F.col("event_id").alias("seq"))
    return op.turns(rows, "chat", "sender", "ts", "text", 120, 30).select("chat", "sender", "started_at", "messages", F.length("text").alias("chars"))


@query("merged_intervals", "WITH i AS (SELECT user_id, epoch(ts) AS a, epoch(ts) + value * 600 AS b FROM events), r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), s AS (SELECT *, sum(CASE WHEN a <= m + 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS merged FROM r) SELECT user_id, CAST(merged AS BIGINT) AS merged, min(a) AS start, max(b) AS \"end\", count(*) AS parts FROM s GROUP BY 1, 2")
def merged_intervals(t: Tables):
    a = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return op.merged_intervals(t.events.select("user_id", a.alias("a"), (a + F.col("value") * 600).alias("b")), ["user_id"], "a", "b", 60)


@query("best_per_key", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_per_key(t: Tables):
    return op.best_per(t.lineitem, ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("last_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def last_wins(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("cap_per_group", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), p AS (SELECT *, CASE WHEN p_size < 40 AND p_brand IN ('Brand#11', 'Brand#12') AND r = 1 THEN 0 WHEN r <= 8 THEN 1 ELSE 2 END AS pass FROM r) SELECT p_partkey, p_brand, pass FROM p ORDER BY pass, p_retailprice DESC, p_partkey LIMIT 100")
def cap_per_group(t: Tables):
    preferred = (F.col("p_size") < 40) & F.col("p_brand").isin("Brand#11", "Brand#12")
    return op.capped_selection(t.part, "p_brand", preferred, [F.desc("p_retailprice"), F.asc("p_partkey")], 100).select("p_partkey", "p_brand", "pass")


@query("tournament_batches", "SELECT batch, count(*) AS n, max(p_partkey) AS last FROM (SELECT p_partkey, CAST(ntile(CAST(ceil((SELECT count(*) FROM part) / 400) AS INT)) OVER (ORDER BY p_partkey) AS INT) AS batch FROM part) GROUP BY 1")
def tournament_batches(t: Tables):
    b = op.even_batches(t.part.select("p_partkey"), [F.asc("p_partkey")], t.part.count())
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


@query("tournament_winners", "WITH b AS (SELECT p_partkey, p_retailprice, ntile(CAST(ceil((SELECT count(*) FROM part) / 400) AS INT)) OVER (ORDER BY p_partkey) AS batch FROM part) SELECT CAST(batch AS INT) AS batch, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY p_retailprice DESC, p_partkey) AS r FROM b) WHERE r <= 12")
def tournament_winners(t: Tables):
    b = op.even_batches(t.part.select("p_partkey", "p_retailprice"), [F.asc("p_partkey")], t.part.count())
    return op.batch_winners(b, [F.desc("p_retailprice"), F.asc("p_partkey")], 12).select("batch", "p_partkey")


@query("pack_batches", "WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem), g AS (SELECT l_orderkey, l_linenumber, i, q AS s, 0 AS batch FROM r WHERE i = 1 UNION ALL SELECT r.l_orderkey, r.l_linenumber, r.i, CASE WHEN s > 0 AND s + q > 60 THEN q ELSE s + q END, CASE WHEN s > 0 AND s + q > 60 THEN batch + 1 ELSE batch END FROM g JOIN r ON r.l_orderkey = g.l_orderkey AND r.i = g.i + 1) SELECT l_orderkey, l_linenumber, batch FROM g")
def pack_batches(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return op.greedy_batches(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity", 60).select("l_orderkey", "l_linenumber", "batch")


@query("quota_admit", "SELECT event_id, event_type = 'purchase' OR sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 20 AS admitted FROM events")
def quota_admit(t: Tables):
    return op.quota_admission(t.events, ["user_id"], F.col("event_type") == "purchase", [F.asc("ts"), F.asc("event_id")], 20).select("event_id", "admitted")


@query("even_picks", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda k: CAST(round_even(k * (n - 1) / 5.0, 0) AS BIGINT)), i)")
def even_picks(t: Tables):
    return op.even_picks(t.events, ["user_id"], [F.asc("value"), F.asc("event_id")], 6).select("user_id", "event_id")


@query("recent_one_per_source", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS nth FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nth, ts DESC, event_id) AS place FROM a) SELECT user_id, event_id, CAST(place AS INT) AS place FROM b WHERE place <= 7")
def recent_one_per_source(t: Tables):
    return op.recent_one_per_source(t.events, ["user_id"], "event_type", [F.desc("ts"), F.asc("event_id")], 7).select("user_id", "event_id", "place")


@query("switch_points", "WITH l AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events), p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) SELECT event_id, before, v FROM p WHERE v IS NOT NULL AND before IS NOT NULL AND v <> before")
def switch_points(t: Tables):
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "error", F.col("event_type")))
    return op.switch_points(rows, ["user_id"], ["ts", "event_id"], "v").select("event_id", "before", "v")


@query("round_robin_quota")
def round_robin_quota(t: Tables):
    return op.round_robin(t.events, "user_id", "event_type", "value", 600, "event_id")


@query("min_gap_selection", "WITH RECURSIVE r AS (SELECT user_id, epoch(ts)::DOUBLE AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), g AS (SELECT user_id, a, i, a AS kept, TRUE AS k FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.a, r.i, CASE WHEN r.a - kept >= 86400 THEN r.a ELSE kept END, r.a - kept >= 86400 FROM g JOIN r ON r.user_id = g.user_id AND r.i = g.i + 1), p AS (SELECT user_id, a, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS place FROM g WHERE k) SELECT user_id, CAST(place AS INT) AS place, a FROM p WHERE place < 12")
def min_gap_selection(t: Tables):
    rows = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"))
    return op.min_gap(rows, ["user_id"], "a", 86400, 12)


@query("rate_limit_fixed", "SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS bucket, count(*) AS calls, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2")
def rate_limit_fixed(t: Tables):
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return t.events.groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("calls"), F.least(F.count("*"), F.lit(2)).alias("allowed"))


@query("timeline_sample", "WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), b AS (SELECT *, ((i + 1) * 3 - 1) // n AS slice FROM r) SELECT conv_id, slice, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, slice ORDER BY length(text) DESC, i) AS k FROM b) WHERE k = 1")
def timeline_sample(t: Tables):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id")
    rows = t.conversations.withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("slice", F.floor(((F.col("i") + 1) * 3 - 1) / F.col("n")))
    return op.best_per(rows, ["conv_id", "slice"], F.desc(F.length("text")), F.asc("i")).select("conv_id", "slice", "turn")

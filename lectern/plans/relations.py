"""Queries over joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import relations as op
from lectern.plans.registry import Tables, query


@query("left_join_names", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def left_join_names(t: Tables):
    return t.customer.join(t.nation.filter("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("anti_not_ordered", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_not_ordered(t: Tables):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("surface_union", "SELECT event_id, event_type FROM events WHERE (event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) OR (event_type = 'click' AND user_id IN (SELECT s_suppkey FROM supplier)) OR (event_type = 'error' AND user_id IN (SELECT p_partkey FROM part WHERE p_size < 10))")
def surface_union(t: Tables):
    sides = [("view", t.customer.filter("c_acctbal > 5000").select("c_custkey")), ("click", t.supplier.select("s_suppkey")), ("error", t.part.filter("p_size < 10").select("p_partkey"))]
    return op.any_of_joins(t.events, "user_id", sides, "event_type").select("event_id", "event_type")


@query("join_chain", "SELECT r_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' GROUP BY 1")
def join_chain(t: Tables):
    rows = t.lineitem.join(t.orders.filter("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("hydrate_in_rank_order", "WITH r AS (SELECT l_partkey, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_partkey LIMIT 30) SELECT CAST(row_number() OVER (ORDER BY score DESC, l_partkey) AS INT) AS rank, p_name FROM r JOIN part ON l_partkey = p_partkey")
def hydrate(t: Tables):
    from pyspark.sql.window import Window

    best = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("score")).orderBy(F.desc("score"), "l_partkey").limit(30)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "l_partkey")))
    return ranked.join(t.part, F.col("l_partkey") == F.col("p_partkey")).orderBy("rank").select("rank", "p_name")


@query("fallback_lookup", "SELECT event_id, coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NOT NULL THEN 'user_id' WHEN b.n IS NOT NULL THEN 'other' END AS resolved_by FROM (SELECT *, user_id * 7 AS other FROM events) e LEFT JOIN (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_acctbal > 0) a ON e.user_id = a.k LEFT JOIN (SELECT s_suppkey AS k, s_name AS n FROM supplier) b ON e.other = b.k")
def fallback_lookup(t: Tables):
    rows = t.events.select("event_id", "user_id", (F.col("user_id") * 7).alias("other"))
    tables = [("user_id", t.customer.filter("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("name")), "c_custkey"), ("other", t.supplier.select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")]
    return op.first_match(rows, tables, "name").select("event_id", "name", "resolved_by")


@query("interleaved_timeline", "SELECT event_id, ts, is_note FROM (SELECT event_id, ts, 0 AS is_note FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, ts, 1 FROM events WHERE event_type = 'error') ORDER BY ts, is_note, event_id")
def interleaved(t: Tables):
    rows = t.events.select("event_id", "ts", "event_type")
    return op.interleave(rows.filter("event_type = 'view'"), rows.filter("event_type = 'error'"), "ts", "event_id").select("event_id", "ts", "is_note")


_SEC = "epoch(ts)"


@query("interval_join", f"WITH a AS (SELECT event_id, user_id, {_SEC} AS t FROM events WHERE event_type = 'purchase' AND event_id % 10 <> 0), s AS (SELECT event_id AS span_id, user_id, {_SEC} AS t FROM events WHERE event_type = 'view'), h AS (SELECT a.event_id, span_id, abs(s.t - a.t) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(s.t - a.t), span_id) AS r FROM a JOIN s ON a.user_id = s.user_id AND s.t >= a.t - 43200 AND s.t <= a.t + 86400) SELECT event_id, span_id, distance FROM h WHERE r = 1 UNION ALL SELECT event_id, f, NULL FROM events JOIN (SELECT user_id, arg_min(span_id, (t, span_id)) AS f FROM s GROUP BY 1) USING (user_id) WHERE event_type = 'purchase' AND event_id % 10 = 0")
def interval_join(t: Tables):
    e = t.events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spans = e.filter("event_type = 'view'").select(F.col("event_id").alias("span_id"), "user_id", "t")
    anchors = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.when(F.col("event_id") % 10 != 0, F.col("t")).alias("t"))
    return op.nearest_in_window(anchors, spans, "user_id", "t", "event_id", "t", 43200, 86400)


@query("typed_targets", "SELECT event_id, kind, CASE kind WHEN 'customer' THEN c_name WHEN 'part' THEN p_name ELSE s_name END AS title FROM (SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'part' ELSE 'supplier' END AS kind FROM events) LEFT JOIN customer ON kind = 'customer' AND c_custkey = user_id LEFT JOIN part ON kind = 'part' AND p_partkey = user_id LEFT JOIN supplier ON kind = 'supplier' AND s_suppkey = user_id")
def typed_targets(t: Tables):
    m = F.col("user_id") % 3
    rows = t.events.select("event_id", F.col("user_id").alias("target_id"), F.when(m == 0, "customer").when(m == 1, "part").otherwise("supplier").alias("kind"))
    lookups = [("customer", t.customer, "c_custkey", "c_name"), ("part", t.part, "p_partkey", "p_name"), ("supplier", t.supplier, "s_suppkey", "s_name")]
    return op.typed_targets(rows, lookups, "kind", "target_id").select("event_id", "kind", "title")


@query("cited_in_scope", "SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey * 2]) AS ref FROM orders) WHERE ref IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def cited_in_scope(t: Tables):
    refs = t.orders.select("o_orderkey", F.explode(F.array("o_custkey", F.col("o_custkey") + 1, F.col("o_custkey") * 2)).alias("ref"))
    scope = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("ref"))
    return refs.join(scope, "ref", "left_semi").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("co_occurring_pairs", "WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 8")
def co_occurring(t: Tables):
    return op.pairs_within(t.lineitem, "l_orderkey", "l_suppkey", 8)


@query("previous_run", "SELECT event_id, lag(event_id) OVER w AS previous_event_id, lag(value) OVER w AS previous_value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def previous_run(t: Tables):
    return op.previous(t.events, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value").select("event_id", "previous_event_id", "previous_value")


@query("union_visible", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_visible(t: Tables):
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(t.customer.filter("c_acctbal < 0").select("c_custkey")).distinct()


_NEW, _OLD = "SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29'", "SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'"


@query("added_and_dropped", f"SELECT *, 'added' AS change FROM ({_NEW} EXCEPT {_OLD}) UNION ALL SELECT *, 'dropped' FROM ({_OLD} EXCEPT {_NEW})")
def added_and_dropped(t: Tables):
    """What each user did of late and not before, and the other way round."""
    key = ["user_id", "event_type"]
    new, old = t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-29'").select(*key), t.events.filter("ts < TIMESTAMP_NTZ '2024-01-03'").select(*key)
    return new.subtract(old).withColumn("change", F.lit("added")).union(old.subtract(new).withColumn("change", F.lit("dropped")))


@query("in_both", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def in_both(t: Tables):
    return t.events.filter("event_type = 'purchase'").select("user_id").intersect(t.events.filter("event_type = 'error' AND value > 90").select("user_id"))


@query("jaccard_sets", "WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-02') AS a, list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-29') AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN a IS NULL AND b IS NULL THEN 1.0 ELSE len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) END AS jaccard FROM s")
def jaccard_sets(t: Tables):
    early, late = F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")
    s = t.events.groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(late, F.col("event_type"))).alias("b"))
    return s.select("user_id", op.jaccard("a", "b").alias("jaccard"))


@query("scope_fingerprint", "SELECT user_id, sha256(array_to_string(list_sort(list(DISTINCT event_type)), chr(10))) AS fingerprint FROM events GROUP BY 1")
def scope_fingerprint(t: Tables):
    return op.scope_fingerprint(t.events, ["user_id"], "event_type")


@query("content_diff", "SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'delete' WHEN b.p_partkey IS NULL OR a.v <> b.v THEN 'upsert' ELSE 'unchanged' END AS action FROM (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 4 <> 0) b ON a.p_partkey = b.p_partkey")
def content_diff(t: Tables):
    a = t.part.filter("p_partkey % 3 <> 0").select("p_partkey", F.col("p_size").alias("v"))
    b = t.part.filter("p_partkey % 4 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return op.content_diff(a, b, "p_partkey", "v")


@query("field_diff", "SELECT c_custkey, 'c_mktsegment' AS field, 'changed' AS change FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'c_name', 'gained' FROM customer WHERE c_custkey % 7 = 0")
def field_diff(t: Tables):
    before = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"))
    after = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_mktsegment", F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_name")
    return op.field_diff(before, after, "c_custkey", ["c_mktsegment", "c_name"])


@query("merged_tags", "SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS tag, user_id FROM events")
def merged_tags(t: Tables):
    return op.merged_tags(t.events.select(F.col("event_type").alias("tag"), "user_id"), "tag", "user_id", "click", "view")


@query("insert_new", "SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-05')")
def insert_new(t: Tables):
    key = ["user_id", "event_type"]
    return op.insert_new(t.events.filter("ts < TIMESTAMP_NTZ '2024-01-05'").select(*key).distinct(), t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-20'").select(*key), key)


@query("additive_upsert", "SELECT user_id, event_type, sum(value) AS value FROM events GROUP BY 1, 2")
def additive_upsert(t: Tables):
    old, new = t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1")
    return op.additive_upsert(old, new, ["user_id", "event_type"], "value")

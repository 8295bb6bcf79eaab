"""Queries over scopes, predicates and pages. Orders stand for documents, nations for tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import filters as op
from lectern.plans.registry import Tables, query

NOW = "1996-01-01 00:00:00"


def order_grants(t: Tables):
    """A document is granted to the nation of its customer."""
    return t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey).select(F.col("o_orderkey").alias("document_id"), F.col("c_nationkey").alias("tenant_id"))


GRANTS = "(SELECT o_orderkey AS document_id, c_nationkey AS tenant_id FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("visible_documents", f"SELECT o_orderkey AS document_id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT document_id FROM {GRANTS} WHERE tenant_id = 7)")
def visible_documents(t: Tables):
    return op.visible(t.orders.withColumnRenamed("o_orderkey", "document_id"), order_grants(t), 7).select("document_id", "o_totalprice")


@query("empty_scope_is_empty", "SELECT o_orderkey FROM orders WHERE FALSE")
def empty_scope(t: Tables):
    return op.in_scope(t.orders, "o_orderkey", []).select("o_orderkey")


@query("scoped_by_table", "SELECT event_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scoped_by_table(t: Tables):
    scope = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return op.in_scope(t.events, "user_id", scope).select("event_id", "value")


@query("library_page", f"SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT document_id FROM {GRANTS} WHERE tenant_id = 7) AND (contains(lower(c_name), '1') OR contains(lower(o_orderpriority), 'urgent')) AND o_orderstatus IN ('O', 'F') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 2")
def library_page(t: Tables):
    docs = op.visible(t.orders.withColumnRenamed("o_orderkey", "document_id"), order_grants(t), 7).withColumnRenamed("document_id", "o_orderkey")
    rows = docs.join(t.customer, docs.o_custkey == t.customer.c_custkey).filter((op.like_any("1", "c_name") | op.like_any("urgent", "o_orderpriority")) & F.col("o_orderstatus").isin("O", "F"))
    return op.page(rows, F.desc("o_orderdate"), F.desc("o_orderkey"), offset=2, n=25).select("o_orderkey", "o_orderdate", "c_name")


@query("match_all_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def match_all_terms(t: Tables):
    return t.documents.filter(op.match_terms("the of Tion", "text")).select("doc_id")


@query("escaped_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND NOT p_name ILIKE '%\\%%' ESCAPE '\\'")
def escaped_like(t: Tables):
    pattern = f"%{op.escaped('%')}%"
    return t.part.filter(F.col("p_name").ilike("%a%") & ~F.col("p_name").ilike(pattern)).select("p_partkey", "p_name")


@query("half_open_window", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'")
def half_open_window(t: Tables):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return t.events.filter(op.half_open("ts", at("2024-01-05 00:00:00"), at("2024-01-12 00:00:00"))).select("event_id")


@query("duration_gate", "SELECT event_id, NOT (value > 0 AND value < 120 AND event_type <> 'purchase') AND value <= 600 AS kept, value > 0 AND value < 120 AND event_type <> 'purchase' AS dropped_as_short FROM events")
def duration_gate(t: Tables):
    return op.duration_gate(t.events, "value", F.col("event_type") == "purchase", most_minutes=10).select("event_id", "kept", "dropped_as_short")


@query("live_rows", "SELECT event_id FROM (SELECT *, CASE WHEN event_type = 'error' THEN ts END AS deleted_at, CASE WHEN event_type = 'view' THEN ts + INTERVAL 10 DAY END AS expires_at FROM events) WHERE deleted_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20 00:00:00')")
def live_rows(t: Tables):
    rows = t.events.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts"))).withColumn("expires_at", F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 10 DAYS")))
    return rows.filter(op.live("deleted_at", "expires_at", now="2024-01-20 00:00:00")).select("event_id")


@query("due_schedules", f"SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '{NOW}' AND (o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 30 DAY < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE)")
def due_schedules(t: Tables):
    rows = t.orders.withColumn("enabled", F.col("o_orderstatus") != "F").withColumn("next_run_at", F.col("o_orderdate")).withColumn("claimed_at", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    return rows.filter(op.due(NOW, 15)).select("o_orderkey")


@query("json_membership", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_membership(t: Tables):
    return t.events.filter(F.contains("props", F.lit("7")) & op.json_member("props", "$.k", "7")).select("event_id")


@query("keyset_page", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 50")
def keyset_page(t: Tables):
    return op.keyset_page(t.events.withColumn("ts", F.col("ts")), "ts", "event_id", "2024-01-15 00:00:00", 50).select("event_id", "ts")


@query("fresh_chunks", "WITH c AS (SELECT l_orderkey AS document_id, l_linenumber - 1 AS chunk_index, CASE WHEN l_linenumber = 1 THEN 4 ELSE 3 + l_linenumber % 2 END AS total_chunks FROM lineitem), f AS (SELECT document_id, max(total_chunks) AS n FROM c WHERE chunk_index = 0 GROUP BY 1) SELECT c.document_id, chunk_index FROM c LEFT JOIN f USING (document_id) WHERE n IS NULL OR (chunk_index < n AND total_chunks = n)")
def fresh_chunks(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.when(F.col("l_linenumber") == 1, 4).otherwise(3 + F.col("l_linenumber") % 2).alias("total_chunks"))
    return op.fresh_chunks(rows).select("document_id", "chunk_index")


@query("name_lookup", "SELECT n_nationkey FROM nation WHERE lower(n_name) = lower('Nation_3') OR lower(n_name) = lower('FRANCE')")
def name_lookup(t: Tables):
    return t.nation.filter((F.lower("n_name") == "nation_3") | (F.lower("n_name") == "france")).select("n_nationkey")

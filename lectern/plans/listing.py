"""Queries over listings, audits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import listing as op
from lectern.plans.registry import Tables, query
from lectern.sources import exports as ex


def _events(t: Tables):
    return t.events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("context_windows", "SELECT a.user_id, a.s, string_agg(CASE WHEN abs(b.s - a.s) <= 3600 THEN '>> ' ELSE '' END || b.event_type, chr(10) ORDER BY b.s, CASE WHEN abs(b.s - a.s) <= 3600 THEN '>> ' ELSE '' END || b.event_type) AS context FROM (SELECT DISTINCT user_id, epoch(ts) AS s FROM events WHERE event_type = 'error') a JOIN (SELECT user_id, epoch(ts) AS s, event_type FROM events) b ON a.user_id = b.user_id AND abs(a.s - b.s) <= 20000 GROUP BY 1, 2")
def context_windows(t: Tables):
    e = _events(t)
    return op.context_around(e.filter("event_type = 'error'").select("user_id", "s").distinct(), e.select("user_id", F.col("s").alias("start"), "event_type"), "user_id", "s", "start", "event_type", 20000, 3600)


@query("owned_segments", "WITH p AS (SELECT CAST(unnest(range(0, 12)) AS BIGINT) AS part), q AS (SELECT part, part * 15.0::DOUBLE AS part_start FROM p), s AS (SELECT event_id, user_id % 12 AS part, value / 5 AS start FROM events) SELECT event_id, s.part, part_start + start AS at FROM s JOIN q USING (part) WHERE (s.part = 0 OR part_start + start >= part_start + 2.5) AND (s.part = 11 OR part_start + start < part_start + 15 + 2.5)")
def owned_segments(t: Tables):
    parts = t.spark.range(12).select(F.col("id").alias("part"), (F.col("id") * 15.0).alias("part_start"), F.lit(15.0).alias("length"))
    rows = t.events.select("event_id", (F.col("user_id") % 12).alias("part"), (F.col("value") / 5).alias("start"))
    return op.owned_segments(rows, parts, 5).select("event_id", "part", "at")


@query("even_segments", r"WITH d AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, CAST(greatest(round_even((turn + 1) * 10 / 8.0, 0), 1) AS BIGINT) AS n FROM conversations), e AS (SELECT conv_id * 100 + turn AS id, w, n, unnest(range(0, n)) AS place, turn FROM d) SELECT id, CAST(place AS INT) AS place, (turn + 1) * 10.0 / n * place AS start, array_to_string(w[1 + (len(w) // n) * place : CASE WHEN place = n - 1 THEN len(w) ELSE (len(w) // n) * (place + 1) END], ' ') AS text FROM e")
def even_segments(t: Tables):
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", ((F.col("turn") + 1) * 10.0).alias("d"))
    return op.even_segments(rows, "id", "text", "d", 8.0)


@query("best_track", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = l_linestatus THEN 0 WHEN l_returnflag IN ('R') THEN 1 WHEN l_returnflag = 'en' THEN 2 WHEN l_quantity > 25 THEN 3 ELSE 4 END, l_quantity > 25, l_linenumber) AS r FROM lineitem WHERE NOT l_discount > 0.08) WHERE r = 1")
def best_track(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("code"), "l_linestatus", (F.col("l_quantity") > 25).alias("generated"), (F.col("l_discount") > 0.08).alias("dubbed"), F.col("l_linenumber").alias("place"))
    return op.best_track(rows, "l_orderkey", "l_linestatus", ["R"]).select("l_orderkey", "l_linenumber")


@query("topic_match", "WITH h AS (SELECT doc_id, contains(lower(left(text, 80)), 'the')::INT + contains(lower(left(text, 80)), 'tion')::INT + contains(lower(left(text, 80)), 'zz')::INT AS a, contains(lower(left(text, 80) || ' ' || text), 'the')::INT + contains(lower(left(text, 80) || ' ' || text), 'tion')::INT + contains(lower(left(text, 80) || ' ' || text), 'zz')::INT AS b FROM documents) SELECT doc_id, b AS hits, b < 2 AS filled FROM h ORDER BY b < 2, CASE WHEN b < 2 THEN 0 ELSE -a END, CASE WHEN b < 2 THEN 0 ELSE -b END, doc_id LIMIT 700")
def topic_match(t: Tables):
    return op.topic_match(t.documents.withColumn("title", F.left("text", F.lit(80))), ["the", "tion", "zz"], "title", "text", "doc_id", 700).select("doc_id", "hits", "filled")


@query("flag_audit", "WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 45 THEN l_orderkey + l_orderkey % 5 * 1000000 ELSE -l_orderkey END AS l_orderkey FROM lineitem) GROUP BY 1) SELECT o_orderpriority, count(*) FILTER (f AND n IS NULL) AS flagged_without_chunks, count(*) FILTER (NOT f AND n IS NOT NULL) AS chunks_without_flag, CAST(coalesce(sum(n) FILTER (f IS NULL), 0) AS BIGINT) AS orphan_chunks FROM (SELECT o_orderkey AS k, o_orderpriority, o_orderstatus = 'O' AS f FROM orders) o FULL JOIN c USING (k) GROUP BY 1")
def flag_audit(t: Tables):
    """Lines as chunks, all of them: of many the document's key leads nowhere."""
    docs = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority", (F.col("o_orderstatus") == "O").alias("f"))
    return op.flag_audit(docs, t.lineitem.select(F.when(F.col("l_quantity") > 45, F.col("l_orderkey") + F.col("l_orderkey") % 5 * 1_000_000).otherwise(-F.col("l_orderkey")).alias("k")), "k", "f", "o_orderpriority")


@query("precedence_merge", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 5 = 0 AND value > 50) DESC, event_id) AS r FROM events WHERE event_id % 5 <> 0 OR value > 50) WHERE r = 1")
def precedence_merge(t: Tables):
    return op.precedence_merge(t.events, ["user_id", "event_type"], F.col("event_id") % 5 == 0, F.col("value") > 50, F.asc("event_id")).select("user_id", "event_type", "event_id")


@query("citation_numbers", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) + 9 AS INT) AS number FROM lineitem")
def citation_numbers(t: Tables):
    return op.citation_numbers(t.lineitem, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"], 10).select("l_orderkey", "l_linenumber", "number")


@query("holdout_sample", "SELECT p_partkey FROM part ORDER BY sha256('11:' || p_partkey), p_partkey LIMIT 20")
def holdout_sample(t: Tables):
    return op.held_out(t.part, "p_partkey", 20, 11).select("p_partkey")


@query("unseen_counts", "SELECT e.user_id, event_type, count(*) AS n FROM events e LEFT JOIN (SELECT user_id, max(ts) AS last_seen FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY 1) s USING (user_id) WHERE ts > coalesce(last_seen, TIMESTAMP '2024-01-20') GROUP BY 1, 2")
def unseen_counts(t: Tables):
    seen = t.events.filter("event_type = 'view' AND user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return op.unseen_counts(t.events, seen, "user_id", "ts", "event_type", "2024-01-20 00:00:00")


@query("digest_sections", " UNION ALL ".join(f"(SELECT '{k}' AS section, event_id AS id, ts AS at, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INT) AS place, count(*) OVER () AS total FROM events WHERE event_type = '{k}' AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-17' ORDER BY ts DESC, event_id LIMIT 5)" for k in ("view", "click", "error")))
def digest_sections(t: Tables):
    return op.digest_sections([(k, t.events.filter(F.col("event_type") == k), "event_id", "ts") for k in ("view", "click", "error")], "2024-01-10", "2024-01-17", 5)


@query("resurfaced", "SELECT c_custkey, last_at FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_at FROM events GROUP BY 1) ON c_custkey = user_id ORDER BY last_at NULLS FIRST, c_custkey LIMIT 1400")
def resurfaced(t: Tables):
    return op.resurfaced(t.customer.select("c_custkey"), t.events.select(F.col("user_id").alias("c_custkey"), "ts"), "c_custkey", "ts", 1400)


@query("since_last", "SELECT coalesce(max(ts) FILTER (ts < TIMESTAMP '2024-01-12'), TIMESTAMP '2024-01-05') AS since FROM events WHERE event_type = 'purchase'")
def since_last(t: Tables):
    return op.since_last(t.events.filter("event_type = 'purchase'"), "ts", "2024-01-12 00:00:00", 7)


@query("custom_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey")
def custom_order(t: Tables):
    return t.orders.orderBy(op.custom_order("o_orderpriority", ["3-MEDIUM", "1-URGENT"]), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("nulls_last_page", "SELECT c_custkey, last_at FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1) ON c_custkey = user_id ORDER BY last_at DESC NULLS LAST, c_custkey LIMIT 40")
def nulls_last_page(t: Tables):
    last = t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_at"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.desc_nulls_last("last_at"), "c_custkey").limit(40)


@query("ordered_members", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def ordered_members(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("orders"))


@query("keyword_hits_order", "SELECT doc_id, hits FROM (SELECT doc_id, contains(lower(text), 'sch')::INT + contains(lower(text), 'eau')::INT + contains(lower(text), 'the')::INT AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 200")
def keyword_hits_order(t: Tables):
    hits = sum([F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ("eau", "the")], F.contains(F.lower("text"), F.lit("sch")).cast("int"))
    return t.documents.select("doc_id", hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(200)


@query("visible_count_per_channel", "SELECT c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def visible_count(t: Tables):
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("o_orderkey").alias("n"))


@query("orphan_evidence", "SELECT o_orderkey, o_custkey + 100 AS ref FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def orphan_evidence(t: Tables):
    refs = t.orders.select("o_orderkey", (F.col("o_custkey") + 100).alias("ref"))
    return refs.join(t.customer.select(F.col("c_custkey").alias("ref")), "ref", "left_anti").select("o_orderkey", "ref")


@query("milestones", "SELECT user_id, count(*) AS jobs, arg_min(event_id, (ts, event_id)) AS first_job, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1")
def milestones(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("jobs"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_job"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))


@query("change_detection", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS ids FROM events GROUP BY 1, 2), p AS (SELECT *, lag(ids) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d) SELECT user_id, day, CASE WHEN before IS NULL THEN 'first' WHEN before = ids THEN 'unchanged' WHEN len(list_intersect(ids, before)) / len(list_distinct(list_concat(ids, before))) < 0.5 THEN 'changed' ELSE 'similar' END AS verdict FROM p")
def change_detection(t: Tables):
    from lectern.operators.relations import jaccard, previous

    d = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("ids"))
    p = previous(d, ["user_id"], ["day"], "ids")
    verdict = F.when(F.col("previous_ids").isNull(), "first").when(F.col("previous_ids") == F.col("ids"), "unchanged").when(jaccard("ids", "previous_ids") < 0.5, "changed").otherwise("similar")
    return p.select("user_id", "day", verdict.alias("verdict"))


@query("qa_dataset_jsonl", "WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(text || chr(0) || answer) AS hash FROM p WHERE role = 'user' AND nr = 'assistant'")
def qa_dataset(t: Tables):
    lines = ex.paired_turns(t.conversations).withColumn("line", ex.chat_json("You answer from the library.", "question", "answer"))
    get = lambda i: F.get_json_object("line", f"$.messages[{i}].content")
    return lines.select("conv_id", "turn", F.md5(F.concat(get(1), F.lit("\0"), get(2))).alias("hash"))


@query("qa_dataset_rows", "SELECT question, answer, created_at FROM (SELECT o_orderpriority || o_orderkey AS question, o_orderstatus AS answer, o_orderdate AS created_at, o_custkey % 5 AS tenant FROM orders UNION ALL SELECT event_type || event_id, props, ts, user_id % 5 FROM events) WHERE tenant = 2")
def qa_rows(t: Tables):
    a = t.orders.select(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderstatus").alias("answer"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 5).alias("tenant_id"))
    b = t.events.select(F.concat("event_type", F.col("event_id").cast("string")).alias("question"), F.col("props").alias("answer"), F.col("ts").alias("created_at"), (F.col("user_id") % 5).alias("tenant_id"))
    return ex.qa_rows([a, b], 2)


@query("knowledge_prompts", "SELECT event_id, 'Tell me about: ' || event_type || ', x' || CASE WHEN k % 2 = 0 THEN ' (also related concepts: c' || k || CASE WHEN k % 3 = 0 THEN ', events: e)' ELSE ')' END WHEN k % 3 = 0 THEN ' (also events: e)' ELSE '' END AS prompt FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def knowledge_prompts(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    none = F.array().cast("array<string>")
    rows = t.events.select("event_id", F.array("event_type", F.lit("x")).alias("t"), F.when(k % 2 == 0, F.array(F.concat(F.lit("c"), k.cast("string")))).otherwise(none).alias("c"), F.when(k % 3 == 0, F.array(F.lit("e"))).otherwise(none).alias("e"))
    return rows.select("event_id", ex.knowledge_prompt("t", "c", "e").alias("prompt"))


@query("upserted_rows", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def upserted_rows(t: Tables):
    old = t.events.filter("event_id < 3000").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))
    new = t.events.filter("event_id >= 3000").select("user_id", "event_type", "value", "event_id")
    return ex.upserted(old, new, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "value")


@query("first_per_key", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def first_per_key(t: Tables):
    return ex.first_per_key(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("until_seen", "WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events), c AS (SELECT user_id, min(place) AS stop FROM i WHERE event_id IN (SELECT max(event_id) FROM events WHERE event_type = 'error' AND user_id % 3 > 0 GROUP BY user_id) GROUP BY 1) SELECT event_id FROM i LEFT JOIN c USING (user_id) WHERE stop IS NULL OR place < stop")
def until_seen(t: Tables):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    cursors = t.events.filter("event_type = 'error' and user_id % 3 > 0").groupBy("user_id").agg(F.max("event_id").alias("seen_id"))
    return op.until_seen(t.events.select("user_id", "event_id", place.alias("place")), "user_id", "place", "event_id", cursors).select("event_id")


@query("first_filled", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE props END, event_type) AS text FROM events")
def first_filled(t: Tables):
    rows = t.events.withColumn("a", F.when(F.col("event_id") % 3 == 1, "  ").when(F.col("event_id") % 3 == 2, F.col("props")))
    return rows.select("event_id", op.first_filled("a", "event_type").alias("text"))


@query("name_exists", "SELECT p_brand, count(*) FILTER (lower(p_name) = lower((SELECT max(p_name) FROM part))) > 0 AS found FROM part GROUP BY 1")
def name_exists(t: Tables):
    """Which brands have a name: the question is one name, the answer a flag each."""
    name = t.part.agg(F.max("p_name")).first()[0]
    assert name is None or op.any_named(t.part, "p_name", name.upper())
    return t.part.groupBy("p_brand").agg(F.bool_or(F.lower("p_name") == (name or "").lower()).alias("found"))

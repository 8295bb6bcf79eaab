"""Queries over a tenant's library. Orders stand for documents, nations for tenants, suppliers for channels, events for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import library as op
from lectern.operators.filters import visible
from lectern.plans.filters import GRANTS, order_grants
from lectern.plans.registry import Tables, query

TENANT = 7


def _documents(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("document_id"), "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")


def _suppliers_of(t: Tables):
    """(document_id, channel_id): the suppliers of an order."""
    return t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("channel_id"))


def _anchored(t: Tables):
    """What tenant 7 may see of each kind: (id, title, text, created_at)."""
    docs = visible(_documents(t), order_grants(t), TENANT)
    name = lambda label, key: F.concat(F.lit(label), F.col(key).cast("string"))
    channels = op.channels_of(TENANT, t.supplier.select(F.col("s_suppkey").alias("channel_id"), F.col("s_nationkey").alias("tenant_id")), order_grants(t), _suppliers_of(t))
    asked = t.events.join(t.customer.filter(f"c_nationkey = {TENANT}").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    at = F.lit("1970-01-01").cast("timestamp_ntz")
    return {
        "documents": docs.select(F.col("document_id").alias("id"), name("order ", "document_id").alias("title"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("created_at")),
        "knowledge": docs.select(F.col("document_id").alias("id"), F.col("o_orderstatus").alias("title"), name("by ", "o_custkey").alias("text"), F.col("o_orderdate").alias("created_at")),
        "jobs": t.customer.filter(f"c_nationkey = {TENANT}").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"), at.alias("created_at")),
        "channels": t.supplier.join(channels, F.col("s_suppkey") == F.col("channel_id"), "left_semi").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("text"), at.alias("created_at")),
        "qa": asked.select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("props").alias("text"), F.col("ts").alias("created_at")),
    }


_SEEN = f"(SELECT document_id FROM {GRANTS} WHERE tenant_id = {TENANT})"
_ENTITIES = f"""
SELECT 'documents' AS type, o_orderkey AS id, 'order ' || o_orderkey AS title, o_orderpriority AS text, o_orderdate AS made FROM orders WHERE o_orderkey IN {_SEEN}
UNION ALL SELECT 'knowledge', o_orderkey, o_orderstatus, 'by ' || o_custkey, o_orderdate FROM orders WHERE o_orderkey IN {_SEEN}
UNION ALL SELECT 'jobs', c_custkey, c_name, c_mktsegment, TIMESTAMP '1970-01-01' FROM customer WHERE c_nationkey = {TENANT}
UNION ALL SELECT 'channels', s_suppkey, s_name, '', TIMESTAMP '1970-01-01' FROM supplier WHERE s_nationkey = {TENANT} OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN {_SEEN})
UNION ALL SELECT 'qa', event_id, event_type, props, ts FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = {TENANT})"""


@query("tenant_search", f"WITH e AS ({_ENTITIES}), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY made DESC, id DESC) AS place FROM e WHERE contains(lower(title), '7') OR contains(lower(text), '7')) SELECT type, CAST(place AS INT) AS place, CAST(id AS VARCHAR) AS id, title, 0.0::DOUBLE AS score FROM r WHERE place <= 5")
def tenant_search(t: Tables):
    """Five kinds, each anchored to the tenant; the question is too short for an index, so by recency."""
    return op.grouped_search(" 7 ", _anchored(t))


_TERMS = "len(regexp_extract_all(lower(title), 'ord')) AS f0, len(regexp_extract_all(lower(text), 'ord')) AS f1, length(title) AS s0, length(text) AS s1"


@query("tenant_search_ranked", f"WITH e AS ({_ENTITIES}), c AS (SELECT *, {_TERMS} FROM e), s AS (SELECT type, count(*) AS n, avg(s0) AS a0, avg(s1) AS a1, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c GROUP BY 1), x AS (SELECT c.type, id, title, made, round(5.0 * ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * s0 / a0)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * s1 / CASE WHEN a1 = 0 THEN 1.0 ELSE a1 END)), 9) AS score FROM c JOIN s USING (type) WHERE f0 + f1 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, made DESC, id DESC) AS place FROM x) SELECT type, CAST(place AS INT) AS place, CAST(id AS VARCHAR) AS id, title, score FROM r WHERE place <= 5")
def tenant_search_ranked(t: Tables):
    return op.grouped_search("ORD", {k: v for k, v in _anchored(t).items()})


@query("tenant_library", f"SELECT o_orderkey AS document_id, o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN {_SEEN} AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)) AND (contains(lower(o_orderpriority), 'e') OR contains(lower(c_name), 'e')) AND o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def tenant_library(t: Tables):
    docs = _documents(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("document_id", F.col("o_orderpriority").alias("title"), F.col("c_name").alias("channel_name"), F.col("o_orderstatus").alias("transcript_status"))
    jobs = _suppliers_of(t).withColumnRenamed("channel_id", "job_id")
    tags = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.lit(TENANT).alias("tenant_id"), F.col("l_returnflag").alias("tag_id"))
    out = op.library_rows(docs, order_grants(t), TENANT, job_ids=list(range(1, 11)), jobs=jobs, search="E", tags=tags, tag="N", transcript_status="O")
    return out.select("document_id", "title")


@query("listed_with_total", "WITH f AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND (contains(lower(o_orderpriority), 'high') OR contains(lower(CAST(o_custkey AS VARCHAR)), 'high') OR contains(lower(o_orderstatus), 'high'))) SELECT o_orderkey, (SELECT count(*) FROM f) AS total FROM (SELECT * FROM f ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 5)")
def listed_with_total(t: Tables):
    rows = t.orders.filter("o_orderstatus = 'F'").withColumn("customer", F.col("o_custkey").cast("string"))
    page, total = op.listed(rows, "HIGH", ("o_orderpriority", "customer", "o_orderstatus"), "o_orderdate", "o_orderdate", "o_orderkey", offset=5, limit=20)
    return page.select("o_orderkey", F.lit(total).cast("long").alias("total"))


@query("history_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 5 = 1 ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 3")
def history_page(t: Tables):
    """Oldest first, as the exchanges of one import."""
    rows = t.orders.filter("o_custkey % 5 = 1")
    return op.listed(rows, None, (), "o_orderdate", "o_orderdate", "o_orderkey", of_one_import=True, offset=3, limit=15)[0].select("o_orderkey", "o_orderdate")


@query("both_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def both_filters(t: Tables):
    return t.events.filter(op.both(F.col("event_type") == "click", None, F.col("value") > 50)).select("event_id")


@query("informative_frames", "SELECT event_id FROM events WHERE event_type = 'view' AND value > 20 AND trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END) <> ''")
def informative_frames(t: Tables):
    frames = t.events.select("event_id", F.when(F.col("event_type") == "view", "described").otherwise("failed").alias("status"), (F.col("value") > 20).alias("informative"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props")).alias("text"))
    return op.informative(frames).select("event_id")


@query("approved_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (1, 2, 3)")
def approved_rows(t: Tables):
    rows = t.lineitem.withColumn("approved", F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False))
    return op.approved(rows, "l_suppkey", "approved", [1, 2, 3]).select("l_orderkey", "l_linenumber")


@query("cited_activity", "WITH h AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS doc FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)), c AS (SELECT DISTINCT id, o_orderdate AS made FROM h JOIN orders ON o_orderkey = id) SELECT 'exchanges' AS kind, CAST(NULL AS VARCHAR) AS id, count(*) AS n, 1::INT AS place FROM c UNION ALL SELECT 'cited', CAST(doc AS VARCHAR), n, CAST(row_number() OVER (ORDER BY n DESC, doc) AS INT) FROM (SELECT doc, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, doc LIMIT 10) UNION ALL SELECT 'recent', CAST(id AS VARCHAR), CAST(NULL AS BIGINT), CAST(row_number() OVER (ORDER BY made DESC, id) AS INT) FROM (SELECT * FROM c ORDER BY made DESC, id LIMIT 10)")
def cited_activity(t: Tables):
    exchanges = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    refs = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("doc"))
    return op.cited_activity(exchanges, refs, t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("doc")))


@query("first_spellings", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), k AS (SELECT doc_id, lower(trim(x)) AS key, arg_min(trim(x), i) AS x, min(i) AS i FROM w WHERE trim(x) <> '' GROUP BY 1, 2) SELECT doc_id, list(x ORDER BY i) AS words FROM k GROUP BY 1")
def first_spellings(t: Tables):
    return op.first_of_each(t.documents.select("doc_id", F.split("text", " ").alias("words")), ["doc_id"], "words")


@query("input_fingerprints", "SELECT user_id, sha256('payload-v1|' || string_agg(event_id || '|' || event_type || '|' || coalesce(props, '') || chr(10), '' ORDER BY event_id)) AS fingerprint FROM events GROUP BY 1")
def input_fingerprints(t: Tables):
    return op.input_fingerprint(t.events, ["user_id"], "event_id", "event_type", "props")


@query("stale_entries", "WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id AS key, CASE WHEN user_id % 4 = 0 THEN 'missing' WHEN user_id % 4 = 1 THEN 'changed' ELSE 'expired' END AS why FROM f WHERE user_id % 4 < 3")
def stale_entries(t: Tables):
    now = t.events.groupBy(F.col("user_id").alias("key")).agg(F.count("*").cast("string").alias("fingerprint"))
    old = F.when(F.col("key") % 4 == 2, "2024-01-01 00:00:00").otherwise("2024-01-09 20:00:00").cast("timestamp_ntz")
    cache = now.filter("key % 4 <> 0").withColumn("fingerprint", F.when(F.col("key") % 4 == 1, "other").otherwise(F.col("fingerprint"))).withColumn("computed_at", old)
    return op.stale(cache, now, "key", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 24)


@query("change_verdicts", "WITH p AS (SELECT a.vec_id AS id, CASE WHEN a.vec_id % 11 > 0 THEN list_distinct([a.vec_id % 2, a.vec_id % 3]) END AS x, list_distinct([b.vec_id % 2, b.vec_id % 3]) AS y, CASE WHEN a.vec_id % 7 > 0 THEN (1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))) / 5 END AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), j AS (SELECT *, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS j FROM p) SELECT id, round(j, 4) AS jaccard, CASE WHEN d IS NOT NULL THEN coalesce(j < 0.5, FALSE) END AS changed, CASE WHEN d IS NULL THEN 'none' WHEN coalesce(j < 0.5, FALSE) = (d > 0.15) THEN CASE WHEN j IS NULL THEN 'embedding_only' ELSE 'agreed' END ELSE 'needs_judge' END AS decided_by FROM j")
def change_verdicts(t: Tables):
    from lectern.operators.retrieval import cosine_distance

    a = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    keys = lambda x: F.array_distinct(F.array(x % 2, x % 3))
    runs = a.join(b, "id").withColumn("x", F.when(F.col("id") % 11 > 0, keys(F.col("id")))).withColumn("y", keys(F.col("id") + 1))
    runs = runs.withColumn("d", F.when(F.col("id") % 7 > 0, cosine_distance("a", "b") / 5))
    return op.change_verdicts(runs, "x", "y", "d").select("id", "jaccard", "changed", "decided_by")


@query("not_deleted", "SELECT event_id FROM events WHERE (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE value > 99)")
def not_deleted(t: Tables):
    facts = t.events.select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("key"), "value")
    return op.not_deleted(facts, facts.filter("value > 99")).select("event_id")


@query("exemplars", "WITH e AS (SELECT *, count(*) FILTER (lang = 'fr') OVER (PARTITION BY source) >= 5 AS enough FROM documents), p AS (SELECT * FROM e WHERE NOT enough OR lang = 'fr'), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM p) SELECT source, doc_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda k: CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT)), i)")
def exemplars(t: Tables):
    return op.exemplars(t.documents, ["source"], "lang", "fr", "n_chars", "doc_id").select("source", "doc_id")


@query("corpus_brackets", "WITH s AS (SELECT source, count(*) AS videos, sum(n_chars) // 6 AS words FROM documents GROUP BY 1), b AS (SELECT source, CASE WHEN videos >= 120 OR words >= 500000 THEN 'xlarge' WHEN videos >= 40 OR words >= 150000 THEN 'large' WHEN videos >= 10 OR words >= 30000 THEN 'medium' ELSE 'small' END AS bracket FROM s) SELECT source, bracket, CASE source WHEN 's1' THEN 0.45 ELSE CASE bracket WHEN 'small' THEN 1.25 WHEN 'medium' THEN 1.1 ELSE 1.0 END END::DOUBLE AS scale FROM b")
def corpus_brackets(t: Tables):
    s = t.documents.groupBy("source").agg(F.count("*").alias("videos"), F.floor(F.sum("n_chars") / 6).alias("words"))
    s = s.withColumn("bracket", op.corpus_bracket(F.col("videos"), F.col("words")))
    return s.select("source", "bracket", op.output_scale(F.col("bracket"), F.when(F.col("source") == "s1", "Brief").otherwise("auto")).alias("scale"))


@query("cadence_signals", "WITH d AS (SELECT source, sum(len(regexp_extract_all(text, '[.!?]'))) AS s, sum(len(regexp_extract_all(text, '\\w+'))) AS w, sum(len(regexp_extract_all(text, '\\?'))) AS q, sum(len(regexp_extract_all(text, '!'))) AS x, sum(len(regexp_extract_all(text, '\\('))) AS p, sum(len(regexp_extract_all(text, '[.!?] [a-z]'))) AS l FROM documents GROUP BY 1) SELECT source, CASE WHEN s >= 20 AND w >= 300 THEN list_filter([CASE WHEN w / s < 12 THEN 'short' WHEN w / s <= 20 THEN 'medium' ELSE 'long' END, CASE WHEN q / s >= 0.15 THEN 'question' END, CASE WHEN x / s >= 0.10 THEN 'exclamation' END, CASE WHEN p / s >= 0.10 THEN 'parenthesis' END, CASE WHEN l / s >= 0.5 THEN 'lowercase' END], lambda h: h IS NOT NULL) ELSE [] END AS habits FROM d")
def cadence_signals(t: Tables):
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    d = t.documents.groupBy("source").agg(count("[.!?]").alias("s"), count("[A-Za-z0-9_]+").alias("w"), count("\\?").alias("question"), count("!").alias("exclamation"), count("\\(").alias("parenthesis"), count("[.!?] [a-z]").alias("l"))
    return d.select("source", op.cadence("s", "w", "l", {h: h for h in ("question", "exclamation", "parenthesis")}).alias("habits"))


@query("writer_inputs", "SELECT 'note' AS kind, CAST(o_orderkey AS VARCHAR) AS ref, o_orderdate AS at, 1::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'qa', CAST(o_orderkey AS VARCHAR), o_orderdate, 1 FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'events', event_type, max(ts), count(*) FROM events GROUP BY event_type")
def writer_inputs(t: Tables):
    one = lambda status: t.orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("at"))
    produced = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref"))
    return op.writer_inputs({"note": one("P"), "qa": one("O")}, {"events": (t.events.withColumnRenamed("ts", "at"), "event_type")}, produced)


@query("best_formats", "WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 99 END AS r FROM events) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) AS i FROM k WHERE r < 99) WHERE i = 1")
def best_formats(t: Tables):
    kind = F.when(F.col("event_type") == "click", "application/SRT").when(F.col("event_type") == "view", "text/vtt").otherwise("text/html")
    return op.best_format(t.events.withColumn("kind", kind), ["user_id"], "kind", "event_id").select("user_id", "event_id")


@query("forms_of_sources", "SELECT coalesce(nullif(f, 'view'), 'English') AS form, count(*) AS sources FROM (SELECT user_id, arg_min(event_type, (ts, event_id)) AS f FROM events GROUP BY 1) GROUP BY 1")
def forms_of_sources(t: Tables):
    profiles = t.events.withColumn("form", F.when(F.col("event_type") != "view", F.col("event_type")))
    return op.forms_of_sources(profiles, "user_id", ["ts", "event_id"], "form")


@query("backfill_report", "WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS old, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS new, o_orderstatus AS origin FROM orders) SELECT count(*) AS considered, count(*) FILTER (new IS NULL) AS no_text, count(new) AS profiled, count(*) FILTER (new <> old) AS changed, count(*) FILTER (new = old) AS unchanged, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT origin || ':' || count(*) AS k FROM o WHERE new IS NOT NULL GROUP BY origin)) AS by_origin FROM o")
def backfill_report(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("origin"))
    made = rows.withColumn("profile", F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "x").otherwise(F.col("profile")))
    return op.backfill_report(rows, made, "id", "profile", "origin")


@query("evidence", "SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS speech, coalesce(list(text ORDER BY turn) FILTER (role <> 'user'), []) AS spans FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0")
def evidence(t: Tables):
    rows = t.conversations.withColumn("kind", F.when(F.col("role") == "user", "speech").otherwise("span"))
    return op.evidence(rows, "conv_id", "kind", "turn", "text").filter(F.size("speech") > 0)


@query("merged_collections", "SELECT l_orderkey, l_linenumber, min(src) AS src FROM (SELECT l_orderkey, l_linenumber, 'legacy' AS src FROM lineitem WHERE l_suppkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 'current' FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY 1, 2")
def merged_collections(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    new, old = rows.filter("l_suppkey % 2 = 0").withColumn("src", F.lit("current")), rows.filter("l_suppkey % 3 <> 0").withColumn("src", F.lit("legacy"))
    return op.merged_collections(new, old, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "src")


@query("synced_uploads", "WITH f AS (SELECT event_id, user_id, ts, value > 60 AS held FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')), a AS (SELECT *, held OR sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 5 AS ok FROM f) SELECT event_id FROM a WHERE ok")
def synced_uploads(t: Tables):
    uploads = t.events.select("event_id", "user_id", "ts", (F.col("value") > 60).alias("held"))
    return op.synced_uploads(uploads, t.events.filter("event_type = 'error'"), ["user_id"], "event_id", [F.asc("ts"), F.asc("event_id")], 5).select("event_id")


_NIGHTS = "WITH g AS (SELECT user_id % 3 AS source, ts AS a, ts + to_microseconds(CAST(value * 6e7 AS BIGINT)) AS b FROM events), r AS (SELECT *, max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g), n AS (SELECT *, CASE WHEN a <= m + INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS fresh FROM r), s AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM n), t AS (SELECT source, k, sum(greatest(0, epoch_us(b) - CASE WHEN fresh = 1 THEN epoch_us(a) ELSE greatest(epoch_us(a), epoch_us(m)) END)) / 6e7 AS minutes, min(a) AS onset, max(b) AS wake FROM s GROUP BY 1, 2), w AS (SELECT *, CAST(wake AS DATE) AS day, row_number() OVER (PARTITION BY CAST(wake AS DATE) ORDER BY minutes DESC, source DESC) AS i FROM t WHERE minutes >= 60), best AS (SELECT * FROM w WHERE i = 1)"


def _nights(t: Tables):
    end = F.expr("ts + make_dt_interval(0, 0, 0, CAST(floor(value * 60000000) AS DECIMAL(20, 0)) / 1000000)")
    g = t.events.select((F.col("user_id") % 3).alias("source"), F.col("ts").alias("a"), end.alias("b"))
    return op.health_nights(g, "source", "a", "b", 2, 60)


@query("health_nights", f"{_NIGHTS.replace('CAST(value * 6e7 AS BIGINT)', 'CAST(floor(value * 60000000) AS BIGINT)')} SELECT day, source, round(minutes, 3) AS minutes, onset FROM best")
def health_nights(t: Tables):
    return _nights(t).select("day", "source", F.round("minutes", 3).alias("minutes"), "onset")


_NOON = "((extract(hour FROM {0}) - 12 + 24) % 24) * 60 + extract(minute FROM {0})"
_CLOCK = "printf('%02d:%02d', CAST((floor(round({0}) % 1440 / 60) + 12) % 24 AS INT), CAST(round({0}) % 60 AS INT))"


@query("sleep_facts", f"{_NIGHTS.replace('CAST(value * 6e7 AS BIGINT)', 'CAST(floor(value * 60000000) AS BIGINT)')}, m AS (SELECT count(*) AS nights, round(median(minutes) / 60, 1) AS median_hours_asleep, median({_NOON.format('onset')}) AS o, median({_NOON.format('wake')}) AS w FROM best) SELECT nights, median_hours_asleep, {_CLOCK.format('o')} AS typical_bedtime, {_CLOCK.format('w')} AS typical_wake_time FROM m")
def sleep_facts(t: Tables):
    return op.sleep_facts(_nights(t))


@query("step_facts", "WITH d AS (SELECT day, max(s) AS s FROM (SELECT CAST(ts AS DATE) AS day, user_id % 4 AS source, sum(value) AS s FROM events GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS days, CAST(floor(median(s)) AS BIGINT) AS median_daily_steps, CAST(floor(avg(s)) AS BIGINT) AS mean_daily_steps FROM d")
def step_facts(t: Tables):
    days = t.events.groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 4).alias("source")).agg(F.sum("value").alias("s")).groupBy("day").agg(F.max("s").alias("s"))
    return op.step_facts(days, "s")


@query("workout_facts", "WITH s AS (SELECT greatest(1.0, (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) / 7) AS weeks FROM events) SELECT event_type AS kind, count(*) AS workouts, round(count(*) / any_value(weeks), 2) AS per_week, round_even(median(value), 0) AS median_minutes FROM events, s GROUP BY 1")
def workout_facts(t: Tables):
    return op.workout_facts(t.events.select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "value"), "day", "kind", "value")


_METRICS = ("llm_tokens_in", "llm_tokens_out", "youtube_units", "whisper_seconds", "llm_calls")


@query("usage_ranking", "WITH u AS (SELECT event_type AS feature, ['llm_tokens_in', 'llm_tokens_out', 'youtube_units', 'whisper_seconds', 'llm_calls'][1 + event_id % 5] AS metric, CAST(floor(value) AS BIGINT) AS amount, CAST(ts AS DATE) AS day FROM events), s AS (SELECT feature, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (metric = '{m}'), 0) AS BIGINT) AS {m}, CAST(coalesce(sum(amount) FILTER (metric = '{m}' AND day = DATE '2024-01-28'), 0) AS BIGINT) AS {m}_today" for m in _METRICS) + " FROM u WHERE day BETWEEN DATE '2024-01-28' - 9 AND DATE '2024-01-28' GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY llm_tokens_in + llm_tokens_out DESC, youtube_units DESC, whisper_seconds DESC, llm_calls DESC, CASE feature WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, feature) AS INT) AS place FROM s")
def usage_ranking(t: Tables):
    metric = F.get(F.array(*[F.lit(m) for m in _METRICS]), (F.col("event_id") % 5).cast("int"))
    rows = t.events.select(F.col("event_type").alias("feature"), metric.alias("metric"), F.floor("value").alias("amount"), F.to_date("ts").alias("day"))
    return op.usage_ranking(rows, "feature", "metric", "amount", "day", F.lit("2024-01-28").cast("date"), 10, ("view", "click"))


@query("stance_and_sentiment", "WITH d AS (SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN event_type <> 'error' THEN event_type END AS stance, CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS sentiment FROM events), c AS (SELECT 'stance' AS kind, month, stance AS label, count(*) AS n FROM d WHERE stance IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'sentiment', month, sentiment, count(*) FROM d GROUP BY 2, 3) SELECT kind, month, list({'label': label, 'n': n} ORDER BY label) AS counts FROM c GROUP BY 1, 2")
def stance_and_sentiment(t: Tables):
    stance = F.when(F.col("event_type") != "error", F.col("event_type"))
    meta = F.to_json(F.struct(F.struct(stance.alias("stance"), F.when(F.col("value") > 50, "positive").otherwise("negative").alias("sentiment")).alias("classification")))
    return op.stance_by_month(t.events.withColumn("meta", meta), "ts", "meta")


@query("script_changes", "WITH s AS (SELECT user_id, event_type AS m, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, count(*) FILTER (m <> p) AS changes FROM s GROUP BY 1")
def script_changes(t: Tables):
    return op.script_changes(t.events, ["user_id"], ["ts", "event_id"], "event_type", ("click", "view"))

"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import statistics as op
from lectern.plans.registry import Tables, query


@query("corpus_stats", "WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus, count(*) AS documents, sum(CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 7 ELSE o_custkey % 5 END) AS words, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(o_orderdate) AS dated, max(CASE WHEN i = n // 2 THEN o_orderdate END) AS median FROM d GROUP BY 1")
def corpus_stats(t: Tables):
    rows = t.orders.withColumn("a", F.col("o_custkey") % 5).withColumn("b", F.col("o_orderkey") % 7)
    return op.corpus_statistics(rows, ["o_orderstatus"], op.first_nonzero("a", "b"), "o_orderdate")


@query("counts_by_year", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS documents FROM orders GROUP BY 1")
def counts_by_year(t: Tables):
    return op.counts_by_year(t.orders, "o_orderdate")


@query("era_summary", "WITH e AS (SELECT event_type, CASE WHEN user_id % 4 > 0 THEN CAST(1900 + user_id % 50 AS INT) END AS s, CASE WHEN user_id % 3 > 0 THEN CAST(1890 + user_id % 90 AS INT) END AS e, value / 100 AS c, user_id % 2 = 0 AS r FROM events) SELECT event_type, count(*) FILTER (s IS NOT NULL AND c > 0) AS known, min(s) FILTER (c > 0) AS earliest, max(greatest(coalesce(e, s), s)) FILTER (s IS NOT NULL AND c > 0) AS latest, count(*) FILTER (s IS NOT NULL AND c > 0 AND r) AS retrospective FROM e GROUP BY 1")
def era_summary(t: Tables):
    u = F.col("user_id")
    rows = t.events.select("event_type", F.when(u % 4 > 0, 1900 + u % 50).cast("int").alias("s"), F.when(u % 3 > 0, 1890 + u % 90).cast("int").alias("e"), (F.col("value") / 100).alias("c"), (u % 2 == 0).alias("r"))
    return op.era_summary(rows, ["event_type"], "s", "e", "c", "r")


@query("channel_report", "WITH v AS (SELECT l_suppkey AS channel, l_orderkey AS video, max(l_partkey) AS w, max(l_quantity) AS e FROM lineitem GROUP BY 1, 2) SELECT channel, count(*) AS videos, CAST(sum(w) AS BIGINT) AS words, CAST(round_even(sum(e) / 60, 0) AS BIGINT) AS minutes FROM v GROUP BY 1")
def channel_report(t: Tables):
    return op.channel_report(t.lineitem.select(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("video"), "l_partkey", "l_quantity"), "channel", "video", "l_partkey", "l_quantity")


@query("month_cadence_filled", "WITH m AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT p, min(month) AS a, max(month) AS b FROM m GROUP BY 1), e AS (SELECT p, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM s) SELECT e.p AS o_orderpriority, e.month, coalesce(n, 0) AS n FROM e LEFT JOIN m ON e.p = m.p AND e.month = m.month")
def month_cadence(t: Tables):
    return op.monthly_cadence(t.orders, "o_orderdate", ["o_orderpriority"])


@query("duration_buckets", "SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN value < 5 THEN '0-5' WHEN value < 15 THEN '5-15' WHEN value < 30 THEN '15-30' WHEN value < 60 THEN '30-60' WHEN value < 120 THEN '60-120' ELSE '120+' END AS bucket, count(*) AS n, round_even(median(value), 1) AS middle FROM events GROUP BY 1")
def duration_buckets(t: Tables):
    rows = t.events.withColumn("s", F.col("value") * 60)
    return rows.groupBy(op.duration_bucket("s").alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.percentile("value", F.lit(0.5)), 1).alias("middle"))


@query("label_counts", "WITH w AS (SELECT lang, doc_id AS doc, label, lower(label) AS key FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS label FROM documents)), d AS (SELECT lang, key, count(DISTINCT doc) AS documents FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY documents DESC, key) AS rank FROM d), s AS (SELECT lang, key, label, row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, length(regexp_replace(label, '[^A-Z]', '', 'g')) DESC, label) AS i FROM (SELECT lang, key, label, count(*) AS n FROM w GROUP BY 1, 2, 3)), x AS (SELECT lang, key, list_sort(list(DISTINCT doc))[1:8] AS examples FROM w GROUP BY 1, 2) SELECT r.lang, CAST(rank AS INT) AS rank, key, label, documents, examples FROM r JOIN s USING (lang, key) JOIN x USING (lang, key) WHERE rank <= 25 AND i = 1")
def label_counts(t: Tables):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))
    return op.label_counts(t.documents.select("lang", "doc_id", words.alias("labels")), "doc_id", "labels", ["lang"])


@query("tfidf_terms", r"WITH d AS (SELECT doc_id, lower(left(text, 40000)) AS text FROM documents ORDER BY doc_id DESC LIMIT 500), w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[\p{L}]{3,}')) AS term FROM d), tf AS (SELECT doc, term, count(*) AS tf FROM w WHERE term NOT IN ('the', 'and') GROUP BY 1, 2), k AS (SELECT term, count(*) AS df, sum(tf) AS al FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY al DESC, term LIMIT 20000), x AS (SELECT doc, term, df, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN k USING (term)), n AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), s AS (SELECT term, sum(w / norm) AS weight, max(df) AS df FROM x JOIN n USING (doc) GROUP BY 1 ORDER BY weight DESC, term LIMIT 60) SELECT term, df, weight / max(weight) OVER () AS weight FROM s")
def tfidf_terms(t: Tables):
    return op.tfidf_terms(t.documents, "doc_id", "text", F.desc("doc_id"), stop=("the", "and"))


@query("stance_by_month", "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stance_by_month(t: Tables):
    return t.events.groupBy(F.trunc(F.col("ts").cast("date"), "week").alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("usage_summary", "SELECT event_type AS feature, user_id % 3 AS metric, sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-25' THEN value ELSE 0 END) AS today, sum(value) AS last_days FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-25' AND CAST(ts AS DATE) > DATE '2024-01-15' GROUP BY 1, 2")
def usage_summary(t: Tables):
    rows = t.events.select(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("feature"), (F.col("user_id") % 3).alias("metric"), "value")
    return op.usage_summary(rows, "day", "2024-01-25", "feature", "metric", "value", 10)


@query("usage_rollup", "SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS amount FROM events GROUP BY ROLLUP (day, event_type)")
def usage_rollup(t: Tables):
    return t.events.select(F.col("ts").cast("date").alias("day"), "event_type", "value").rollup("day", "event_type").agg(F.sum("value").alias("amount"))


@query("period_quota", 'SELECT user_id AS "user", date_trunc(\'day\', ts) AS period_start, count(*) AS consumed, count(*) >= 4 AS blocked, CASE WHEN count(*) >= 4 THEN date_trunc(\'day\', ts) + INTERVAL 1 DAY END AS retry_at FROM events GROUP BY user_id, date_trunc(\'day\', ts)')
def period_quota(t: Tables):
    return op.period_quota(t.events, "user_id", "ts", "day", 4)


@query("daily_best_source", "WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id % 4 AS source, sum(value) AS total FROM events GROUP BY 1, 2) SELECT day, max(total) AS total FROM s GROUP BY 1")
def daily_best_source(t: Tables):
    return op.daily_best_total(t.events.withColumn("source", F.col("user_id") % 4), F.col("ts").cast("date"), "source", "value")


@query("readiness", "WITH c AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, sum(value) AS v FROM events GROUP BY 1), f AS (SELECT user_id, least(greatest(n / 60.0, 0), 1) AS events, least(greatest(k / 5.0, 0), 1) AS kinds, least(greatest(v / 5000, 0), 1) AS volume FROM c) SELECT user_id, CAST(events AS DOUBLE) AS events, CAST(kinds AS DOUBLE) AS kinds, volume, (events + kinds + volume) / 3 AS readiness, events >= 1 AND kinds >= 1 AND volume >= 1 AS ready FROM f")
def readiness(t: Tables):
    c = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k"), F.sum("value").alias("v"))
    return c.select("user_id", *op.gate([("events", F.col("n"), 60), ("kinds", F.col("k"), 5), ("volume", F.col("v"), 5000)]))


@query("prf_scores", "WITH x AS (SELECT toxic AS g, CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END AS f FROM labels JOIN documents USING (doc_id) WHERE quality = 1), c AS (SELECT count(*) FILTER (f = 1 AND g = 1) AS tp, count(*) FILTER (f = 1 AND g = 0) AS fp, count(*) FILTER (f = 0 AND g = 1) AS fn FROM x) SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c")
def prf_scores(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").select(F.col("toxic").alias("g"), F.when(F.length("text") % 2 == 0, 1).otherwise(0).alias("f"), "quality")
    return op.precision_recall(rows, "g", "f", F.col("quality") != 1)


@query("confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(t: Tables):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS worst, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(t: Tables):
    return op.latency(t.events, ["event_type"], "value")


@query("starved_groups", "WITH c AS (SELECT l_suppkey AS k, count(*) AS chunks FROM lineitem GROUP BY 1), i AS (SELECT l_suppkey AS k, count(*) AS items FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 30 GROUP BY 1) SELECT c.k AS l_suppkey, chunks, coalesce(items, 0) AS items FROM c LEFT JOIN i USING (k) WHERE chunks >= 10 AND coalesce(items, 0) / chunks < 0.2")
def starved_groups(t: Tables):
    return op.starved_groups(t.lineitem, t.lineitem.filter("l_returnflag = 'R' AND l_quantity < 30"), "l_suppkey")


@query("structural_union", "WITH x AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'speech' ELSE 'visual' END AS m FROM events) SELECT user_id, event_type, day, min(event_id) AS event_id, list_sort(list(DISTINCT m)) AS modalities, count(*) AS copies FROM x GROUP BY 1, 2, 3")
def structural_union(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"), F.when(F.col("event_id") % 2 == 0, "speech").otherwise("visual").alias("m"))
    return op.structural_union(rows, ["user_id", "event_type", "day"], "event_id", "m")


@query("merge_signals", "WITH x AS (SELECT user_id, event_type, CAST(ts AS DATE) AS src, CASE WHEN event_id % 400 = 1 THEN 'rejected' WHEN event_id % 9 = 1 THEN 'source_deleted' ELSE 'new' END AS st FROM events) SELECT user_id, event_type, count(DISTINCT src) AS weight, CASE WHEN bool_or(st = 'source_deleted') THEN 'revived' ELSE 'active' END AS state FROM x GROUP BY 1, 2 HAVING NOT bool_or(st = 'rejected')")
def merge_signals(t: Tables):
    i = F.col("event_id")
    rows = t.events.select("user_id", "event_type", F.col("ts").cast("date").alias("src"), F.when(i % 400 == 1, "rejected").when(i % 9 == 1, "source_deleted").otherwise("new").alias("st"))
    return op.merge_signals(rows, ["user_id", "event_type"], "src", "st")


_STYLE = r"WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM documents), g AS (SELECT source, 'trigram' AS kind, unnest(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(w, CAST(i AS INT), 3))) AS key FROM w), p AS (SELECT source, kind, key, count(*) AS n FROM (SELECT source, 'word' AS kind, w AS key FROM w UNION ALL SELECT * FROM g) GROUP BY 1, 2, 3)"


@query("style_profile", _STYLE + " SELECT source, kind, key, CAST(n AS BIGINT) AS n FROM p")
def style_profile(t: Tables):
    return op.style_profile(t.documents, ["source"], "text")


@query("style_similarity", _STYLE + ", o AS (SELECT kind, key, n AS m FROM p WHERE source = 'src1'), d AS (SELECT source, kind, sum(n * m) AS d FROM p JOIN o USING (kind, key) GROUP BY 1, 2), c AS (SELECT source, p.kind, coalesce(any_value(d), 0) / (sqrt(sum(n * n)) * any_value(z)) AS c FROM p LEFT JOIN d USING (source, kind) JOIN (SELECT kind, sqrt(sum(m * m)) AS z FROM o GROUP BY 1) USING (kind) GROUP BY 1, 2) SELECT source, round_even(sum(c * 0.5), 4) AS similarity FROM c GROUP BY 1")
def style_similarity(t: Tables):
    return op.style_similarity(op.style_profile(t.documents, ["source"], "text"), "source", "src1")


_SCRIPTS = {name: len_ for name, len_ in ((n, f"len(regexp_extract_all(text, '\\p{{{n.capitalize()}}}'))") for n in op.SCRIPTS)}


@query("script_profile", f"WITH c AS (SELECT lang, {', '.join(f'{c} AS {n}' for n, c in _SCRIPTS.items())} FROM documents), s AS (SELECT lang, {' + '.join(_SCRIPTS)} AS total, * EXCLUDE (lang) FROM c) SELECT lang, {', '.join(f'avg({n} / nullif(total, 0)) AS {n}' for n in _SCRIPTS)} FROM s GROUP BY 1")
def script_profile(t: Tables):
    return t.documents.select("lang", *op.script_shares("text")).groupBy("lang").agg(*[F.avg(n).alias(n) for n in op.SCRIPTS])


@query("unit_scores", "WITH t AS (SELECT user_id AS u, CASE WHEN event_type IN ('view', 'click') THEN 'hi' ELSE 'en' END AS g, CASE WHEN value > 40 THEN 'hi' ELSE 'en' END AS f FROM events WHERE event_type <> 'signup'), u AS (SELECT u, bool_or(g = 'hi') AS g, bool_or(f = 'hi') AS f, avg(CASE WHEN g = 'hi' THEN 1 ELSE 0 END) AS a, avg(CASE WHEN f = 'hi' THEN 1 ELSE 0 END) AS b, count(*) FILTER (g = f) AS same, count(*) AS n FROM t GROUP BY 1) SELECT count(*) FILTER (g AND f) / nullif(count(*) FILTER (f), 0) AS unit_precision, count(*) FILTER (g AND f) / nullif(count(*) FILTER (g), 0) AS unit_recall, avg(abs(a - b)) AS share_mae, sum(same) / sum(n) AS agreement FROM u")
def unit_scores(t: Tables):
    rows = t.events.select("user_id", "event_type", F.when(F.col("event_type").isin("view", "click"), "hi").otherwise("en").alias("g"), F.when(F.col("value") > 40, "hi").otherwise("en").alias("f"))
    return op.unit_scores(rows, "user_id", "g", "f", "hi", F.col("event_type") == "signup")


@query("undated_rows", "SELECT o_orderpriority, count(*) FILTER (o_orderkey % 9 = 0) AS undated FROM orders GROUP BY 1")
def undated_rows(t: Tables):
    return op.undated(t.orders.withColumn("at", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))), "at", ["o_orderpriority"])


@query("share_of_total", "WITH s AS (SELECT source, sum(n_chars) AS words FROM documents GROUP BY 1) SELECT source, CAST(words AS BIGINT) AS words, round_even(100 * words / sum(words) OVER (), 1) AS share FROM s")
def share_of_total(t: Tables):
    s = t.documents.groupBy("source").agg(F.sum("n_chars").alias("words"))
    return s.withColumn("share", op.share_of_total(s, "words"))


@query("category_confidence", "SELECT p_brand, count(*) AS n, round(least(0.8, 0.4 + 0.1 * (count(*) - 1)), 2)::DOUBLE AS confidence FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15")
def category_confidence(t: Tables):
    c = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return c.withColumn("confidence", op.capped_confidence("n")).orderBy(F.desc("n"), "p_brand").limit(15)


@query("cost_estimate", "SELECT o_orderpriority, sum(o_totalprice * 1000 * CASE WHEN o_orderstatus <> 'P' THEN 3.5 END / 1000000) AS cost FROM orders GROUP BY 1")
def cost_estimate(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.sum(op.cost_estimate(F.col("o_totalprice"), F.lit(1000), F.when(F.col("o_orderstatus") != "P", 3.5))).alias("cost"))


@query("distinct_jobs_per_document", "SELECT l_partkey, count(DISTINCT l_suppkey) AS jobs, count(*) AS n FROM lineitem GROUP BY 1")
def distinct_jobs(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("jobs"), F.count("*").alias("n"))


@query("ordered_distinct_topics", "WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, i := event_id)) AS f FROM events GROUP BY 1, 2) SELECT user_id, list(event_type ORDER BY f) AS topics FROM f GROUP BY 1")
def ordered_distinct_topics(t: Tables):
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]).alias("topics"))


@query("blind_test_share", "SELECT event_type, count(*) AS n, avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) >= 20 AND avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) <= 0.6 AS passed FROM events GROUP BY 1")
def blind_test_share(t: Tables):
    share = F.avg(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), share.alias("share"), ((F.count("*") >= 20) & (share <= 0.6)).alias("passed"))


@query("first_last_event", "SELECT min(ts) AS first_at, max(ts) AS last_at, arg_min(event_id, (ts, event_id)) AS first_event, count(DISTINCT user_id) AS users, bool_or(event_type = 'error') AS any_error FROM events")
def first_last_event(t: Tables):
    return t.events.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.countDistinct("user_id").alias("users"), F.bool_or(F.col("event_type") == "error").alias("any_error"))

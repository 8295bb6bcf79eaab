"""Queries over spans of tagged words: a user's events stand for a span's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import languages as op
from lectern.operators import tagging
from lectern.plans.registry import Tables, query

_TAGS = "CASE event_type WHEN 'view' THEN 'en' WHEN 'error' THEN 'other' WHEN 'signup' THEN 'name' ELSE 'hi' END"


@query("span_analysis", f"WITH t AS (SELECT user_id % 40 || '/' || CAST(floor(epoch(ts) / 86400) AS BIGINT) AS span, {_TAGS} AS tag, event_id % 10 AS norm FROM events), v AS (SELECT *, CASE WHEN norm IN (1, 2) AND tag IN ('en', 'hi') THEN norm * 1.0 ELSE 0 END AS w FROM t), s AS (SELECT span, count(*) FILTER (tag = 'en') AS e, count(*) FILTER (tag IN ('hi', 'other')) AS h, count(*) FILTER (tag = 'other') AS u, coalesce(sum(w) FILTER (tag = 'en'), 0) AS we, coalesce(sum(w) FILTER (tag = 'hi'), 0) AS wh FROM v GROUP BY 1), m AS (SELECT *, CASE WHEN u > e THEN 'hi' WHEN we > wh THEN 'en' WHEN wh > we THEN 'hi' WHEN e + h = 0 THEN 'none' WHEN h > e THEN 'hi' ELSE 'en' END AS matrix, CASE WHEN e + h > 0 THEN h / (e + h) ELSE 0.0 END AS share FROM s) SELECT span, e AS en_tokens, h AS hi_tokens, share AS hi_share, matrix, CASE WHEN matrix = 'en' AND h > 0 THEN 'hi' WHEN matrix = 'hi' AND e > 0 THEN 'en' END AS embedded, CASE WHEN share <= 0 OR matrix = 'none' OR (matrix <> 'hi' AND share <= 0.2) THEN 'plain_english' WHEN matrix = 'hi' AND share >= 0.6 THEN 'native_script' ELSE 'roman' END AS mode FROM m")
def span_analysis(t: Tables):
    tag = F.when(F.col("event_type") == "view", "en").when(F.col("event_type") == "error", "other").when(F.col("event_type") == "signup", "name").otherwise("hi")
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("string")
    tokens = t.events.select(F.concat((F.col("user_id") % 40).cast("string"), F.lit("/"), day).alias("span"), tag.alias("tag"), (F.col("event_id") % 10).cast("string").alias("norm"))
    morphemes = t.spark.createDataFrame([(lang, n, float(n)) for lang in ("en", "hi") for n in ("1", "2")], "tag string, norm string, weight double")
    return op.span_analysis(tokens, morphemes, "span").withColumn("mode", op.rendering_mode())


_WINDOWS_SQL = r"""WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B]+'), lambda w: w <> '') AS w FROM conversations),
a AS (SELECT conv_id, flatten(list(w ORDER BY i)) AS w FROM p GROUP BY 1),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS done, CAST([] AS BIGINT[]) AS cuts FROM a
  UNION ALL
  SELECT f.conv_id, p.i, CASE WHEN (held + len(w)) % 40 >= 12 THEN 0 ELSE (held + len(w)) % 40 END, done + len(w),
    list_concat(list_concat(cuts, list_transform(range(1, CAST((held + len(w)) // 40 AS BIGINT) + 1), lambda k: done - held + k * 40)), CASE WHEN (held + len(w)) % 40 >= 12 THEN [done + len(w)] ELSE [] END)
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1
), l AS (SELECT conv_id, max_by(cuts, i) AS cuts, max(done) AS n FROM f GROUP BY 1),
e AS (SELECT conv_id, n, CASE WHEN n = coalesce(list_max(cuts), 0) THEN cuts WHEN len(cuts) > 0 AND n - list_max(cuts) < 6 THEN list_concat(cuts[1:len(cuts) - 1], [n]) ELSE list_concat(cuts, [n]) END AS ends FROM l),
x AS (SELECT e.conv_id, unnest(range(len(ends))) AS k, ends, w FROM e JOIN a USING (conv_id))
SELECT conv_id, CAST(k AS INT) AS "window", array_to_string(w[(CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1:ends[k + 1]], ' ') AS text FROM x"""


@query("transcript_windows", _WINDOWS_SQL)
def transcript_windows(t: Tables):
    """Conversations as transcripts, their turns as segments."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"])
    return op.transcript_windows(t.conversations.groupBy("conv_id").agg(turns.alias("pieces")), "conv_id", "pieces")


_PROFILE_SQL = """WITH s AS (SELECT user_id % 40 AS source, event_id AS w, CAST(floor(value) AS BIGINT) % 9 AS e, event_id % 7 AS h, CASE WHEN user_id % 4 = 0 THEN event_id % 7 ELSE 0 END AS o, CASE user_id % 3 WHEN 0 THEN 'Devanagari' WHEN 1 THEN 'Latin' ELSE 'Bengali' END AS native FROM events),
m AS (SELECT *, CASE WHEN e + h = 0 THEN 'none' WHEN h > e THEN 'hi' ELSE 'en' END AS matrix, CASE WHEN e + h = 0 THEN 0.0 ELSE h / (e + h) END AS share FROM s),
r AS (SELECT *, CASE WHEN share <= 0 OR matrix = 'none' OR (matrix <> 'hi' AND share <= 0.2) THEN 'plain_english' WHEN matrix = 'hi' AND share >= 0.6 THEN 'native_script' ELSE 'roman' END AS mode FROM m),
c AS (SELECT source, count(*) FILTER (mode <> before) AS flicker FROM (SELECT source, mode, lag(mode) OVER (PARTITION BY source ORDER BY w) AS before FROM r WHERE mode <> 'plain_english') GROUP BY 1),
n AS (SELECT source, native, row_number() OVER (PARTITION BY source ORDER BY sum(h) DESC, native) AS k FROM r WHERE h > 0 GROUP BY 1, 2),
a AS (SELECT source, sum(e) AS e, sum(h) AS h, sum(o) AS o, coalesce(sum(e + h) FILTER (matrix = 'hi'), 0) AS fh, coalesce(sum(e + h) FILTER (matrix = 'en'), 0) AS fe, count(*) AS windows, count(*) FILTER (mode = 'plain_english') AS plain_english_windows, count(*) FILTER (mode = 'roman') AS roman_windows, count(*) FILTER (mode = 'native_script') AS native_script_windows FROM r GROUP BY 1),
p AS (SELECT a.*, n.native AS native_script, CASE WHEN fh + fe > 0 THEN round(fh / (fh + fe), 4) ELSE 0.0 END AS matrix_hi_share, CASE WHEN h > 0 THEN round((h - o) / h, 4) END AS named_share, CASE WHEN e + h > 0 THEN round(h / (e + h), 4) ELSE 0.0 END AS hi_share FROM a LEFT JOIN n ON n.source = a.source AND k = 1),
q AS (SELECT *, CASE WHEN e + h = 0 THEN 'none' WHEN native_script = 'Latin' AND named_share < 0.5 AND h / (e + h) > 0.2 THEN 'other' WHEN matrix_hi_share < 0.5 THEN 'en' WHEN native_script IN ('Devanagari', 'Arabic', 'Latin') THEN 'hi' ELSE 'other' END AS primary_language FROM p)
SELECT q.source, primary_language, native_script, hi_share, named_share, matrix_hi_share, CASE WHEN hi_share <= 0 OR primary_language = 'none' OR (primary_language = 'en' AND hi_share <= 0.2) THEN 'plain_english' WHEN primary_language IN ('hi', 'other') AND hi_share >= 0.6 THEN 'native_script' ELSE 'roman' END AS quote_mode, windows, plain_english_windows, roman_windows, native_script_windows, coalesce(flicker, 0) AS flicker FROM q LEFT JOIN c USING (source)"""


@query("transcript_profiles", _PROFILE_SQL)
def transcript_profiles(t: Tables):
    """A user's events stand for the windows of a source."""
    kind = F.col("user_id") % 3
    rows = t.events.select(
        (F.col("user_id") % 40).alias("source"),
        F.col("event_id").alias("w"),
        (F.floor("value").cast("long") % 9).alias("en_tokens"),
        (F.col("event_id") % 7).alias("hi_tokens"),
        F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 7).otherwise(0).alias("other_tokens"),
        F.when(kind == 0, "Devanagari").when(kind == 1, "Latin").otherwise("Bengali").alias("native"),
    )
    e, h = F.col("en_tokens"), F.col("hi_tokens")
    rows = rows.withColumn("matrix", F.when(e + h == 0, "none").when(h > e, "hi").otherwise("en")).withColumn("hi_share", F.when(e + h == 0, 0.0).otherwise(h / (e + h)))
    return op.transcript_profile(rows.withColumn("mode", op.rendering_mode()), "source", "w")


@query("tagged_words")
def tagged_words(t: Tables):
    """Every whole text: how many of its words are in each language, by a model of the documents whose id no 4 divides."""
    model = tagging.fit(t.documents.filter("doc_id % 4 <> 0"), "text", "lang", "en", "de")
    tags = tagging.tagged(t.documents.select("doc_id", "lang", "text"), model, "text", "en", "de").drop("text")
    count = lambda tag: F.size(F.filter("tags", lambda x: x["tag"] == tag)).alias(f"n_{tag}")
    return tags.select("doc_id", "lang", count("en"), count("de"), count("xx"), count("ne"))

"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import alignment, markup
from lectern.functions import text as fn
from lectern.operators.relations import jaccard
from lectern.plans.registry import Tables, query


_PARTS = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("sentences", f"SELECT doc_id, {_PARTS} AS sentences FROM documents")
def sentences(t: Tables):
    return t.documents.select("doc_id", fn.sentences("text").alias("sentences"))


@query("sentence_times", f"WITH p AS (SELECT conv_id, turn, {_PARTS} AS p FROM conversations), x AS (SELECT conv_id, turn, unnest(p) AS sentence, unnest(range(len(p))) AS place, len(p) AS n, list_sum(list_transform(p, lambda s: length(s))) AS total FROM p), y AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY conv_id, turn ORDER BY place) - length(sentence) AS before FROM x) SELECT conv_id, turn, CAST(place AS INT) AS place, sentence, turn + before / total AS start, CASE WHEN place = n - 1 THEN turn + 1.0::DOUBLE ELSE turn + (before + length(sentence)) / total END - (turn + before / total) AS duration FROM y")
def sentence_times(t: Tables):
    return fn.sentence_times(t.conversations.withColumn("start", F.col("turn").cast("double")).withColumn("duration", F.lit(1.0)), "text", "start", "duration", ["conv_id", "turn"])


@query("html_text", r"WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 50000 THEN left(t, 50000) || '...' ELSE t END AS text FROM a")
def html_text(t: Tables):
    return t.pages.select("page_id", fn.plain_html("html").alias("text"))


@query("headings", r"WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?i)(</?)title', '\1h2', 'g'), '(?is)<h[23][^>]*>(.*?)</h[23]>', 1) AS h FROM pages), u AS (SELECT page_id, trim(regexp_replace(regexp_replace(unnest(h), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS h, unnest(range(len(h))) AS i FROM h), k AS (SELECT page_id, h, min(i) AS i FROM u WHERE h <> '' GROUP BY 1, 2) SELECT page_id, list(h ORDER BY i) AS headings FROM k GROUP BY 1")
def headings(t: Tables):
    """Titles stand for headings, of which the pages have few."""
    rows = t.pages.select("page_id", fn.headings(F.regexp_replace("html", "(?i)(</?)title", "$1h2"), 1000).alias("headings"))
    return rows.filter(F.size("headings") > 0)


@query("url_keys", r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'HTTPS://www.' END || upper(regexp_extract(url, '://([^/]+)', 1)) || regexp_extract(url, '://[^/]+(.*)', 1) || CASE page_id % 3 WHEN 0 THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || page_id || '&v=abcdefgh' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '&q=a%20b*~' WHEN 1 THEN CASE WHEN contains(url, '?') THEN '&x#part' ELSE '/?x#part' END ELSE '' END AS u, CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) || CASE WHEN page_id % 3 < 2 THEN '&' ELSE '' END ELSE '' END AS own FROM (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages))
SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN lower(regexp_extract(u, '://www\.([^/?#]+)', 1)) || regexp_replace(regexp_extract(u, '://[^/?#]+([^?#]*)', 1), '/+$', '') || '?' || own || CASE page_id % 3 WHEN 0 THEN 'v=abcdefgh' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '&q=a+b%2A~' WHEN 1 THEN 'x=' ELSE '' END END AS key, nullif(regexp_extract(u, '(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '') AS video FROM p""")
def url_keys(t: Tables):
    """Every address with its host in capitals: a third with a time, a video and a coded query, a third with a name alone and a fragment, and some without a scheme."""
    i = F.col("page_id").cast("string")
    asked = F.contains(F.col("url"), F.lit("?"))
    video = F.concat(F.when(asked, "&").otherwise("?"), F.lit("t="), i, F.lit("&v=abcdefgh"), F.lpad(i, 3, "0"), F.lit("&q=a%20b*~"))
    end = F.when(F.col("page_id") % 3 == 0, video).when(F.col("page_id") % 3 == 1, F.when(asked, "&x#part").otherwise("/?x#part")).otherwise("")
    scheme = F.when(F.col("page_id") % 7 == 0, "").otherwise("HTTPS://www.")
    host, rest = F.regexp_extract("url", "://([^/]+)", 1), F.regexp_extract("url", "://[^/]+(.*)", 1)
    pages = t.pages.withColumn("url", F.regexp_replace("url", "#.*", "")).select("page_id", F.concat(scheme, F.upper(host), rest, end).alias("url"))
    return pages.select("page_id", fn.url_key("url").alias("key"), fn.video_id("url").alias("video"))


@query("clock_times", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, CASE WHEN s > 0 THEN s END AS seconds FROM (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events)")
def clock_times(t: Tables):
    s = F.floor(F.col("value") * 97).cast("long")
    iso = F.format_string("PT%dH%dM%dS", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return t.events.select("event_id", fn.clock(s).alias("clock"), F.nullif(fn.iso_duration(iso), F.lit(0)).cast("long").alias("seconds"))


@query("era_labels", "SELECT p_partkey, CASE WHEN a = b THEN CASE WHEN a < 0 THEN -a || ' BCE' ELSE a::VARCHAR END WHEN a < 0 AND b < 0 THEN -a || '-' || -b || ' BCE' ELSE CASE WHEN a < 0 THEN -a || ' BCE' ELSE a::VARCHAR END || '-' || b END AS era FROM (SELECT p_partkey, p_size - 25 AS a, p_size - 25 + p_partkey % 3 * 9 AS b FROM part)")
def era_labels(t: Tables):
    a = F.col("p_size") - 25
    return t.part.withColumn("a", a).withColumn("b", a + (F.col("p_partkey") % 3 * 9)).select("p_partkey", fn.era_label("a", "b").alias("era"))


@query("era_payloads", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN least(k, 50) ELSE k END AS \"start\", CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN greatest(k, 50) ELSE k END AS \"end\", CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN least(round(k / 60.0, 2), 1.0) ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def era_payloads(t: Tables):
    """One bound only; both, as texts and in any order, with a confidence above 1 at times; an end and a confidence that is no number."""
    k = F.get_json_object("props", "$.k")
    shapes = [F.concat(F.lit('{"start": '), k, F.lit("}")), F.concat(F.lit('{"start": "'), k, F.lit('", "end": 50, "confidence": '), (k.cast("double") / 60).cast("string"), F.lit("}")), F.concat(F.lit('{"end": '), k, F.lit(', "confidence": "high"}'))]
    payload = F.get(F.array(*shapes), (F.col("event_id") % 3).cast("int"))
    return t.events.select("event_id", payload.alias("p")).select("event_id", fn.era_payload("p").alias("e")).select("event_id", "e.*")


@query("visual_marks", r"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a b' ELSE 'a  [VISUAL open ' || event_id END AS t FROM events")
def visual_marks(t: Tables):
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a  [VISUAL x "), i, F.lit("]  b"))).otherwise(F.concat(F.lit("a  [VISUAL open "), i))
    return t.events.select("event_id", fn.without_visuals(text).alias("t"))


@query("slugs", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(t: Tables):
    return t.part.select("p_partkey", fn.slug("p_name").alias("slug"))


@query("redacted_logs", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '?key=***&x=1 sk-***' WHEN 1 THEN 'at AIza*** and ***' WHEN 2 THEN 'ftp://***@host/' || page_id ELSE 'key ' || page_id END AS t FROM pages")
def redacted_logs(t: Tables):
    i = F.col("page_id").cast("string")
    shapes = [F.concat("url", F.lit("?key="), i, F.lit("&x=1 sk-abcdefghijkl"), i), F.concat(F.lit("at AIzaabcdefghijk"), i, F.lit(" and eyJab.cd.ef")), F.concat(F.lit("ftp://u:p@host/"), i), F.concat(F.lit("key "), i)]
    line = F.get(F.array(*shapes), (F.col("page_id") % 4).cast("int"))
    return t.pages.select("page_id", fn.redacted(line).alias("t"))


@query("shared_shingles", "WITH s AS (SELECT doc_id, w FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)), x AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM s) SELECT a.doc_id, CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END AS jaccard FROM x a JOIN x b ON b.doc_id = a.doc_id + 1")
def shared_shingles(t: Tables):
    docs = t.documents.select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    sides = pairs.select("doc_id", fn.shingles("text", 3).alias("s"), fn.shingles("next", 3).alias("o"))
    return sides.select("doc_id", jaccard("s", "o").alias("jaccard"))


@query("chunk_docs")
def chunk_docs(t: Tables):
    return fn.chunked(t.documents, "doc_id", "text")


@query("reassembled_docs")
def reassembled_docs(t: Tables):
    chunks = fn.chunked(t.documents, "doc_id", "text", 128, 32).select("doc_id", "chunk_index", F.col("chunk").alias("text"))
    return fn.reassembled(chunks, "doc_id", "chunk_index", "text")


@query("balanced_pages")
def balanced_pages(t: Tables):
    """Whole pages, pages that end in a half-written link, and pages with open items."""
    end = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, '<div><p>cut <a href="https://x').otherwise("<ul><li>a")
    return t.pages.select("page_id", markup.balanced_html(F.concat("html", end)).alias("html"))


@query("quote_check")
def quote_check(t: Tables):
    """Every text's opening against the next text, and a part of its own against itself, every seventh character of it lost."""
    sides = t.documents.select("doc_id", "text").join(t.documents.select((F.col("doc_id") + 1).alias("doc_id"), F.left("text", F.lit(80)).alias("quote")), "doc_id")
    own = F.regexp_replace(F.substring("text", 10, 60), "(?s)(.{6}).", "$1")
    return alignment.with_quote_matches(sides, {"other": "quote", "own": own}, "text").select("doc_id", "other", "own")


@query("edit_words")
def edit_words(t: Tables):
    """Every turn as an edit of the one before it in its conversation, with the one before that as the passage."""
    turns = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    earlier = lambda n, name: turns.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    sides = turns.join(earlier(1, "draft"), ["conv_id", "turn"]).join(earlier(2, "passage"), ["conv_id", "turn"], "left")
    return alignment.with_edits(sides, "draft", "text", "passage").select("conv_id", "turn", "edits.*")


_MIXED = "translate(text, 'aeo', 'аεо')"


@query("mixed_scripts", f"WITH t AS (SELECT doc_id, {_MIXED} AS t FROM documents), n AS (SELECT doc_id, t, len(regexp_extract_all(t, '\\p{{Cyrillic}}')) AS c, len(regexp_extract_all(t, '\\p{{Greek}}')) AS g FROM t) SELECT doc_id, list_filter(regexp_extract_all(t, '[^\\s\\x0B]+'), lambda w: regexp_matches(w, '\\p{{Cyrillic}}') AND regexp_matches(w, '\\p{{Greek}}')) AS words, CASE WHEN c + g = 0 THEN NULL WHEN c >= g THEN 'CYRILLIC' ELSE 'GREEK' END AS script FROM n")
def mixed_scripts(t: Tables):
    """Texts with some Latin letters replaced by look-alikes."""
    text = F.translate("text", "aeo", "аεо")
    return t.documents.select("doc_id", fn.mixed_script_words(text).alias("words"), fn.dominant_script(text).alias("script"))

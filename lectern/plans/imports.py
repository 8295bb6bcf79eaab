"""Queries over importers and exports: the tables are written in an export's format to the shared folder, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators.stored import shared_folder
from lectern.sources import exports as ex
from lectern.sources import imports as im
from lectern.plans.registry import Tables, query

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/lectern/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, kind: str, **options) -> str:
    df.write.options(**options).format(kind).save(path)
    return path


def _json(t: Tables, df: DataFrame, name: str) -> str:
    return _written(df, _folder(t, name), "json")


def _csv(t: Tables, df: DataFrame, path: str) -> str:
    return _written(df, path, "csv", header=True, escape='"')


def _named(label: str, key: str):
    return F.concat(F.lit(label), F.col(key).cast("string"))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query("import_music", f"SELECT {_STAMP} || '+00:00|' || CASE WHEN event_type IN ('view', 'click') THEN 'uri:' || event_id ELSE left(sha1('Show ' || event_id || chr(31) || CASE WHEN event_type = 'error' THEN 'None' ELSE 'Host ' || user_id END), 20) END AS external_id, CASE WHEN event_type IN ('view', 'click') THEN 'played_track' ELSE 'played_episode' END AS event_type, date_trunc('second', ts) AS occurred_at, CASE WHEN event_type IN ('view', 'click') THEN 'Song ' || event_id || ' — Band ' || user_id WHEN event_type = 'error' THEN 'Show ' || event_id ELSE 'Show ' || event_id || ' — Host ' || user_id END AS title FROM events WHERE value <= 90")
def import_music(t: Tables):
    track = F.col("event_type").isin("view", "click")
    rows = t.events.select(
        F.date_format("ts", ISO).alias("ts"),
        (F.col("value") > 90).alias("incognito_mode"),
        F.when(track, _named("Song ", "event_id")).alias("master_metadata_track_name"),
        F.when(track, _named("Band ", "user_id")).alias("master_metadata_album_artist_name"),
        F.when(track, _named("uri:", "event_id")).alias("spotify_track_uri"),
        F.when(~track, _named("Show ", "event_id")).alias("episode_name"),
        F.when(~track & (F.col("event_type") != "error"), _named("Host ", "user_id")).alias("episode_show_name"),
    )
    out = im.music_history(t.spark, _json(t, rows, "music"), lines=True)
    return out.select("external_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "title")


@query("import_watches", "SELECT 'yt-watch:abcdef' || lpad(CAST(event_id AS VARCHAR), 5, '0') || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS external_id, 'watched_video' AS event_type, date_trunc('second', ts) AS occurred_at, 'Film ' || event_id AS title, 'Channel ' || user_id AS text FROM events WHERE event_type <> 'error'")
def import_watches(t: Tables):
    video = F.concat(F.lit("abcdef"), F.lpad(F.col("event_id").cast("string"), 5, "0"))
    ad = F.when(F.col("event_type") == "error", F.array(F.struct(F.lit("From Google Ads").alias("name"))))
    rows = t.events.select(F.concat(F.lit("Watched "), _named("Film ", "event_id")).alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("titleUrl"), F.date_format("ts", ISO).alias("time"), F.array(F.struct(_named("Channel ", "user_id").alias("name"), F.lit("u").alias("url"))).alias("subtitles"), ad.alias("details"))
    out = im.watch_history(t.spark, _json(t, rows, "watches"), lines=True)
    return out.select("external_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "title", "text")


@query("import_searches", f"SELECT 'yt-search:' || {_STAMP} || '+00:00:' || left(sha1(event_type || ' ' || user_id), 20) AS external_id, 'searched_youtube' AS event_type, event_type || ' ' || user_id AS title, event_type || ' ' || user_id AS text, date_trunc('second', ts) AS occurred_at FROM events")
def import_searches(t: Tables):
    rows = t.events.select(F.lit("Searched").alias("title"), F.concat(F.lit("https://www.youtube.com/results?search_query="), F.col("event_type"), F.lit("+"), F.col("user_id").cast("string")).alias("titleUrl"), F.date_format("ts", ISO).alias("time"))
    out = im.search_history(t.spark, _json(t, rows, "searches"), lines=True)
    return out.select("external_id", "event_type", "title", "text", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query("import_notes", "SELECT 'T' || event_id || CASE WHEN event_type = 'view' THEN '' ELSE chr(10) || chr(10) || 'body' END || chr(10) || chr(10) || '- [x] ' || user_id || chr(10) || '- [ ] eggs' AS text, date_trunc('second', ts) AS occurred_at FROM events WHERE event_type <> 'error'")
def import_notes(t: Tables):
    item = lambda x, done: F.struct(x.cast("string").alias("text"), F.lit(done).alias("isChecked"))
    rows = t.events.select(_named("T", "event_id").alias("title"), F.when(F.col("event_type") == "view", " ").otherwise("body").alias("textContent"), (F.col("event_type") == "error").alias("isTrashed"), F.array(item(F.col("user_id"), True), item(F.lit("eggs"), False)).alias("listContent"), (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1_000_000).alias("userEditedTimestampUsec"))
    out = im.notes(t.spark, _json(t, rows, "notes"), lines=True)
    return out.select("text", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


_SHELF = "CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'to-read' ELSE 'lent' END"


@query("import_books", f"SELECT 'gr:' || o_orderkey || ':' || {_SHELF} AS external_id, CASE o_orderstatus WHEN 'F' THEN 'read_book' WHEN 'O' THEN 'want_to_read' ELSE 'shelved_book' END AS event_type, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY ELSE date_trunc('day', o_orderdate) END AS occurred_at, 'Book, ' || o_orderkey || ' by Ann ' || o_custkey AS title, 'good' || chr(10) || 'bad' AS text, nullif(o_custkey % 6, 0) AS rating FROM orders")
def import_books(t: Tables):
    shelf = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "to-read").otherwise("lent")
    rows = t.orders.select(F.col("o_orderkey").alias("Book Id"), _named("Book, ", "o_orderkey").alias("Title"), _named("Ann ", "o_custkey").alias("Author"), (F.col("o_custkey") % 6).alias("My Rating"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy/MM/dd")).alias("Date Read"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date Added"), shelf.alias("Exclusive Shelf"), F.lit("good<br/>bad").alias("My Review"))
    out = im.books(t.spark, _csv(t, rows, _folder(t, "books")))
    return out.select("external_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "title", "text", "rating")


@query("import_films", "WITH f AS (SELECT p_partkey, 'F' || p_partkey AS n, CAST(1900 + p_size AS VARCHAR) AS y, (p_partkey % 10) / 2 AS r FROM part), e AS (SELECT 'lb:diary:' || n || y || '2024-01-04' AS external_id, 'watched_film' AS event_type, n, y, r::DOUBLE AS rating, NULL AS text FROM f WHERE p_partkey % 3 = 0 UNION ALL SELECT 'lb:watched:' || n || y, 'watched_film', n, y, r::DOUBLE, NULL FROM f WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'lb:watchlist:' || n || y, 'want_to_watch', n, y, NULL, NULL FROM f WHERE p_partkey % 7 = 0 UNION ALL SELECT 'lb:review:' || n || y || '2024-01-04', 'reviewed_film', n, y, r::DOUBLE, 'Good' FROM f WHERE p_partkey % 5 = 0) SELECT external_id, event_type, n || ' (' || y || ')' AS title, rating, text FROM e")
def import_films(t: Tables):
    path = _folder(t, "films")
    films = t.part.select("p_partkey", _named("F", "p_partkey").alias("Name"), (F.col("p_size") + 1900).alias("Year"), ((F.col("p_partkey") % 10) / 2).alias("Rating"), F.lit("2024-01-05").alias("Date"), F.lit("2024-01-04").alias("Watched Date"), F.lit("Good").alias("Review"))
    write = lambda n, df, *columns: _csv(t, df.select("Date", "Name", "Year", *columns), f"{path}/{n}.csv")
    write("diary", films.filter("p_partkey % 3 = 0"), "Rating", "Watched Date")
    write("ratings", films, "Rating")
    write("reviews", films.filter("p_partkey % 5 = 0"), "Rating", "Review", "Watched Date")
    write("watched", films)
    write("watchlist", films.filter("p_partkey % 7 = 0"))
    return im.films(t.spark, path).select("external_id", "event_type", "title", "rating", "text")


@query("import_health", "SELECT event_type AS type, 'device ' || user_id AS source, date_trunc('second', ts) AS start, CAST(event_id AS VARCHAR) AS value FROM events")
def import_health(t: Tables):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss +0000")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    rows = t.events.select(F.col("event_type").alias("_type"), _named("device ", "user_id").alias("_sourceName"), stamp.alias("_startDate"), stamp.alias("_endDate"), F.col("event_id").cast("string").alias("_value"))
    out = im.health_records(t.spark, _written(rows, _folder(t, "health"), "xml", rootTag="HealthData", rowTag="Record"))
    return out.select("type", "source", F.col("start").cast("timestamp_ntz").alias("start"), "value")


@query("import_feed", "SELECT 'Post ' || event_id AS title, 'https://x/' || event_id AS link, date_trunc('second', ts) AS published_at FROM events")
def import_feed(t: Tables):
    stamp = F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    rows = t.events.select(_named("Post ", "event_id").alias("title"), _named("https://x/", "event_id").alias("link"), stamp.alias("pubDate"), F.col("event_type").alias("description"))
    out = im.feed_items(t.spark, _written(rows, _folder(t, "feed"), "xml", rootTag="channel", rowTag="item"))
    return out.select("title", "link", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("import_subtitles", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS place, 'turn ' || turn AS text, turn * 10.0 + 0.5 AS start, 2.25::DOUBLE AS duration FROM conversations")
def import_subtitles(t: Tables):
    clock = lambda s: F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.pmod(F.floor(s / 60), F.lit(60)).cast("int"), F.pmod(s, F.lit(60)).cast("int")), F.lit(","))
    at = (F.col("turn") * 10).cast("long")
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), clock(at), F.lit("500 --> "), clock(at + 2), F.lit("750\n<i>turn</i>\n"), F.col("turn").cast("string"), F.lit("\n"))
    bodies = t.conversations.select("conv_id", F.struct("turn", cue.alias("cue")).alias("c")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "\n").alias("body"))
    return im.subtitles(bodies, "conv_id", "body")


@query("import_chat", "SELECT user_id AS chat, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS message, 'U' || event_id % 3 AS sender, date_trunc('minute', ts) AS at, CASE event_type WHEN 'error' THEN '<Media omitted>' WHEN 'signup' THEN 'This message was deleted' ELSE event_type || chr(10) || 'more' END AS text, CASE event_type WHEN 'error' THEN 'media' WHEN 'signup' THEN 'deleted' ELSE 'text' END AS kind FROM events")
def import_chat(t: Tables):
    body = F.when(F.col("event_type") == "error", "<Media omitted>").when(F.col("event_type") == "signup", "This message was deleted").otherwise(F.col("event_type"))
    head = F.concat(F.date_format("ts", "yyyy/MM/dd, HH:mm"), F.lit(" - U"), (F.col("event_id") % 3).cast("string"), F.lit(": "), body)
    lines = F.when(F.col("event_type").isin("error", "signup"), F.array(head)).otherwise(F.array(head, F.lit("more")))
    rows = t.events.select(F.col("user_id").alias("chat"), F.col("event_id"), F.posexplode(lines).alias("i", "line")).withColumn("n", F.col("event_id") * 10 + F.col("i"))
    out = im.chat_messages(rows, "chat", "n", "line")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("flattened_threads", "WITH RECURSIVE c AS (SELECT user_id AS thread, event_id AS id, CAST(floor(value) AS BIGINT) AS score, CASE WHEN i % 4 = 1 THEN NULL ELSE lag(event_id, CAST(1 + i % 3 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)), r AS (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY thread, parent ORDER BY score DESC, id) AS VARCHAR), 8, '0') AS rank FROM c), w AS (SELECT thread, id, 0 AS depth, rank AS path FROM r WHERE parent IS NULL UNION ALL SELECT r.thread, r.id, depth + 1, path || '/' || rank FROM w JOIN r ON r.thread = w.thread AND r.parent = w.id), p AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY path) AS place FROM w) SELECT thread, CAST(place AS INT) AS place, depth, repeat('↳ ', depth) || 'a: ' || id AS line FROM p WHERE place <= 50")
def flattened_threads(t: Tables):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    i = F.row_number().over(w)
    rows = t.events.withColumn("i", i)
    back = F.coalesce(*[F.when(F.col("i") % 3 == k, F.lag("event_id", k + 1).over(w)) for k in range(3)])
    rows = rows.select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), F.when(F.col("i") % 4 != 1, back).alias("parent"), F.lit("a").alias("author"), F.col("event_id").cast("string").alias("body"), F.col("value").cast("long").alias("score"))
    return im.flattened_threads(rows)


@query("reply_depths", "WITH RECURSIVE p AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 11 = 1 THEN -event_id - 10 ELSE event_id - 1 END AS up FROM events), w AS (SELECT id, 1 AS depth FROM p WHERE up = -1 UNION ALL SELECT p.id, depth + 1 FROM w JOIN p ON p.up = w.id) SELECT p.id, coalesce(w.depth, 1) AS depth FROM p LEFT JOIN w USING (id)")
def reply_depths(t: Tables):
    """Chains, with orphans whose parent does not exist."""
    up = F.when(F.col("event_id") % 7 == 0, -1).when(F.col("event_id") % 11 == 1, -F.col("event_id") - 10).otherwise(F.col("event_id") - 1)
    return im.reply_depths(t.events.select(F.col("event_id").alias("id"), up.alias("in_reply_to"), F.lit(-1).cast("long").alias("root")))


@query("stored_posts", "SELECT 'reddit' AS source_type, CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS author, event_type AS title, 'a & b' AS text, CAST(floor(value) AS BIGINT) AS score FROM events WHERE event_type IN ('view', 'click') AND ts > TIMESTAMP '2024-01-10' UNION ALL SELECT 'bluesky', CAST(event_id AS VARCHAR), 'u' || user_id, NULL, event_type, CAST(floor(value) AS BIGINT) FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-10'")
def stored_posts(t: Tables):
    """Two services' listings; a third one's is no listing at all and fails alone."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000)
    score = F.floor("value").cast("long")
    reddit = t.events.filter("event_type in ('view', 'click')").select(F.to_json(F.struct(F.col("event_id").alias("id"), _named("u", "user_id").alias("author"), F.col("event_type").alias("title"), F.lit("<b>a & b</b>").alias("selftext"), score.alias("score"), epoch.alias("created_utc"))).alias("value"))
    author = F.struct(_named("u", "user_id").alias("handle"))
    sky = t.events.filter("event_type = 'purchase'").select(F.to_json(F.struct(F.col("event_id").alias("uri"), author.alias("author"), F.struct(F.col("event_type").alias("text")).alias("record"), score.alias("likeCount"), F.date_format("ts", ISO_MICROS).alias("indexedAt"))).alias("value"))
    out, _ = im.fanned_out({"reddit": reddit, "bluesky": sky, "gopher": sky}, since=F.lit("2024-01-10").cast("timestamp"))
    return out.select("source_type", "id", "author", "title", "text", "score")


@query("notes_round_trip", "SELECT event_id AS note_id, 'doc' AS target_type, CAST(user_id AS VARCHAR) AS target_id, coalesce(props, '') AS body_md, date_trunc('second', ts) AS created_at, CASE WHEN event_type = 'error' THEN date_trunc('second', ts) END AS deleted_at FROM events")
def notes_round_trip(t: Tables):
    at = F.date_trunc("second", "ts").cast("timestamp_ntz")
    notes = t.events.select(F.col("event_id").alias("note_id"), F.lit("doc").alias("target_type"), F.col("user_id").alias("target_id"), F.col("props").alias("body_md"), at.alias("created_at"), F.when(F.col("event_type") == "error", at).alias("deleted_at"))
    return ex.note_from_json_ld(t.spark.read.text(_written(ex.note_json_ld(notes).select("value"), _folder(t, "json_ld"), "text")))


@query("notes_markdown", "SELECT 'doc' AS target_type, user_id AS target_id, '## doc ' || user_id || chr(10) || string_agg('- ' || event_type, chr(10) ORDER BY ts, event_id) AS markdown FROM events WHERE event_type <> 'error' GROUP BY user_id")
def notes_markdown(t: Tables):
    notes = t.events.select(F.col("event_id").alias("note_id"), F.lit("doc").alias("target_type"), F.col("user_id").alias("target_id"), F.col("event_type").alias("body_md"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))
    return ex.note_markdown(notes)


@query("archive_manifest", "SELECT 'events' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'nation', count(*) FROM nation")
def archive_manifest(t: Tables):
    return ex.write_archive({"events": t.events, "nation": t.nation}, _folder(t, "archive")).select("table", "rows")


@query("cascade_delete", "SELECT 'orders' AS kind, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'events', event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(t: Tables):
    left = ex.cascade_delete({"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")}, t.customer.filter("c_nationkey = 3").select("c_custkey"))
    one = lambda n, c: left[n].select(F.lit(n).alias("kind"), F.col(c).alias("id"))
    return one("orders", "o_orderkey").unionByName(one("events", "event_id"))


@query("tuple_rows", "SELECT conv_id, turn, '{\"system\":\"s\",\"user\":\"' || conv_id || '\",\"assistant\":\"' || turn || '\"}' AS line FROM conversations")
def tuple_rows(t: Tables):
    return t.conversations.select("conv_id", "turn", ex.tuple_json("s", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("line"))


@query("text_windows", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) <= 12 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:4], ' ') || chr(10) || '[...]' || chr(10) || array_to_string(w[len(w) // 2 - 1:len(w) // 2 + 2], ' ') || chr(10) || '[...]' || chr(10) || array_to_string(w[len(w) - 3:], ' ') END AS sample FROM w")
def text_windows(t: Tables):
    return t.documents.select("doc_id", fn.sample_windows("text", 4).alias("sample"))


_TERMS = r"""WITH x AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}][\p{L}\p{N}\p{M}''’]*'), lambda w: regexp_replace(regexp_replace(w, '[''’]+$', ''), '(?i)[''’]s$', '')), lambda w: w <> '') AS w FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' ’The’ Cat’s news, LOSS' ELSE 'on the  with' END AS text FROM conversations)),
k AS (SELECT *, list_filter(w, lambda w: lower(replace(w, '’', '''')) NOT IN ({stop})) AS k FROM x),
t AS (SELECT *, CASE WHEN len(k) > 0 THEN k ELSE w END AS a FROM k),
u AS (SELECT conv_id, turn, text, w, list_filter(a, lambda y, i: list_position(list_transform(a, lambda z: lower(z)), lower(y)) = i) AS terms FROM t),
q AS (SELECT *, [trim(text), array_to_string(terms, ' '), array_to_string(terms[1:3], ' '), array_to_string(terms[1:2], ' ')] AS q FROM u)
""".replace("{stop}", ", ".join(f"'{w}'" for w in fn.STOP_WORDS))
_KEY = "CASE WHEN length(y) > 4 AND regexp_matches(lower(y), '[^s]s$') THEN left(lower(y), length(y) - 1) ELSE lower(y) END"


def _topics(t: Tables):
    """Turns as topics: as they are, with apostrophes and words that only look like plurals, and of stop words alone."""
    text = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" ’The’ Cat’s news, LOSS"))).otherwise("on the  with")
    return t.conversations.select("conv_id", "turn", text.alias("text"))


@query("topic_terms", _TERMS + f"SELECT conv_id, turn, terms, list_sort(list_distinct(list_transform(terms, lambda y: {_KEY}))) AS keys, list_sort(list_distinct(list_transform(w, lambda y: {_KEY}))) AS all_keys, list_filter(q, lambda y, i: list_position(list_transform(q, lambda z: lower(z)), lower(y)) = i AND y <> '') AS queries FROM q")
def topic_terms(t: Tables):
    return _topics(t).select("conv_id", "turn", fn.topic_terms("text").alias("terms"), F.array_sort(fn.topic_keys("text")).alias("keys"), F.array_sort(fn.term_keys("text")).alias("all_keys"), fn.topic_queries("text").alias("queries"))


@query("hashtag_phrases", _TERMS + r""", g AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]', '', 'g')) AS whole, list_filter(list_transform(terms, lambda y: lower(regexp_replace(y, '[^\p{L}\p{N}\p{M}]', '', 'g'))), lambda y: y <> '') AS tags FROM u),
j AS (SELECT *, list_concat([whole, array_to_string(tags, '')], list_transform(range(1, len(tags)), lambda i: tags[i] || tags[i + 1])) AS j FROM g),
p AS (SELECT *, list_filter(j, lambda y, i: list_position(j, y) = i AND y <> '' AND length(y) <= 30) AS p FROM j),
o AS (SELECT *, list_filter(tags, lambda y, i: list_position(tags, y) = i AND NOT list_contains(p, y)) AS o FROM p),
s AS (SELECT conv_id, turn, p, list_sort(list_transform(o, lambda y, i: {'n': -length(y), 'i': i, 't': y})) AS s FROM o)
SELECT conv_id, turn, p[1:5] AS phrases, list_transform(s[1:3], lambda y: y.t) AS words FROM s""")
def hashtag_phrases(t: Tables):
    phrases, words = fn.hashtags("text")
    return _topics(t).select("conv_id", "turn", phrases.alias("phrases"), words.alias("words"))


@query("words_any_script", "SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}]+(?:[''’][\\p{L}\\p{M}]+)*') AS words FROM documents")
def words_any_script(t: Tables):
    return t.documents.select("doc_id", fn.words_any_script("text").alias("words"))


@query("verbatim_quotes", r"""WITH q AS (SELECT doc_id, text, regexp_replace(regexp_replace(left(text, 40), '^\s+|\s+$', '', 'g'), '^["''“”]+|["''“”]+$', '', 'g') AS q FROM documents)
SELECT doc_id, CASE WHEN length(regexp_replace(regexp_replace(q, '^\s+', ''), '\s+', ' ', 'g')) >= 8 THEN regexp_replace(q, '^\s+', '') END AS span FROM q""")
def verbatim_quotes(t: Tables):
    """Every text holds its own opening with its spaces doubled, unless that is too short to count."""
    quote = F.replace(F.left("text", F.lit(40)), F.lit(" "), F.lit("  "))
    return t.documents.select("doc_id", fn.verbatim_span(quote, F.col("text")).alias("span"))


@query("article_pages", "WITH p AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages) SELECT page_id, title FROM p WHERE title <> ''")
def article_pages(t: Tables):
    from lectern.sources.connectors import Articles

    return Articles(t.pages, "page_id", "url", "html").fetch_metadata(None).select("page_id", "title")


@query("walked_channel", "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#11' AND p_size > 10 AND contains(lower(p_name), 'a')")
def walked_channel(t: Tables):
    from lectern.sources.connectors import Stored, connector_for, register

    register("part", Stored(t.part, "p_partkey", "p_brand", "p_size", ("p_name",), "p_name"))
    c = connector_for("part")
    return c.list_creator_items("Brand#11", since=10).join(c.search("A").select("id"), "id", "left_semi").select("id")

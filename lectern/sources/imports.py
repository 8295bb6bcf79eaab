"""Importers: personal exports as tables of events, shares and facts. Each takes what Spark's readers give.

Event rows: external_id, event_type, occurred_at, title, text. Rows that cannot be dated or named are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.stored import checkpoints

EVENT = ["external_id", "event_type", "occurred_at", "title", "text"]


def row_id(*parts: str | Column) -> Column:
    """A stable id of the parts, whatever their order of arrival."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256), F.lit(32))


def short_id(*parts: str | Column) -> Column:
    """Fixed form of the ids of untagged plays: the first 20 digits of the SHA-1 of the parts, None for a missing one."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.left(F.sha1(F.concat_ws("\x1f", *texts).cast("binary")), F.lit(20))


def parsed_time(value: str | Column, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def optional(df: DataFrame, *names: str) -> DataFrame:
    """df with null columns for those of a layout it lacks."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def _filled(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


# --- listening, watching, reading -------------------------------------------------------------------------------------


def _json(spark: SparkSession, path: str, lines: bool, schema: str | None = None) -> DataFrame:
    """An export's JSON: one array a file, or an object a line, which Spark reads in parts."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def music_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Both layouts of a music service's history (ts or endTime), times in UTC. Private sessions are skipped; no address is kept."""
    df = optional(_json(spark, path, lines), "ts", "endTime", "artistName", "trackName", "incognito_mode", "master_metadata_track_name", "master_metadata_album_artist_name", "spotify_track_uri", "episode_name", "episode_show_name", "spotify_episode_uri", "audiobook_title", "audiobook_chapter_title", "audiobook_uri")
    at = F.coalesce(parsed_time("ts", "yyyy-MM-dd'T'HH:mm:ssX"), parsed_time("endTime", "yyyy-MM-dd HH:mm"))
    # (kind, name, by, uri): the first kind that has a name counts.
    kinds = [
        ("track", _filled("master_metadata_track_name", "trackName"), _filled("master_metadata_album_artist_name", "artistName"), _filled("spotify_track_uri")),
        ("episode", _filled("episode_name"), _filled("episode_show_name"), _filled("spotify_episode_uri")),
        ("audiobook", _filled("audiobook_chapter_title", "audiobook_title"), _filled("audiobook_title"), _filled("audiobook_uri")),
    ]
    plays = F.coalesce(*[F.when(name.isNotNull(), F.struct(F.lit(f"played_{kind}").alias("kind"), name.alias("name"), by.alias("by"), uri.alias("uri"))) for kind, name, by, uri in kinds])
    private = F.coalesce(F.col("incognito_mode").cast("boolean"), F.lit(False))
    rows = df.filter(~private).select(at.alias("at"), plays.alias("p")).filter("at is not null and p is not null").select("at", "p.*")
    when = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    title = F.concat_ws(" — ", "name", "by")
    return rows.select(F.concat_ws("|", when, F.coalesce("uri", short_id("name", "by"))).alias("external_id"), F.col("kind").alias("event_type"), F.col("at").alias("occurred_at"), title.alias("title"), F.col("by").alias("text"))


def _iso(at: Column) -> Column:
    """A UTC time as ids hold it: microseconds only where there are some."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def _activity(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Entries of a video service's history that are no advertisements, with their time (at)."""
    df = _json(spark, path, lines, "title string, titleUrl string, time string, subtitles array<struct<name:string,url:string>>, details array<struct<name:string>>")
    ad = F.coalesce(F.exists("details", lambda d: F.contains(F.lower(d["name"]), F.lit("ads"))), F.lit(False))
    return df.filter(~ad).withColumn("at", parsed_time("time", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX")).filter("at is not null")


def watch_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Watched videos; entries without a video's address are left out."""
    addresses = (r"youtube\.com(?::\d+)?/watch\?(?:[^#]*&)?v=([^&#]+)", r"^\w+://[^/?#]*youtu\.be/+([^?#]+)")
    video = F.coalesce(*[F.nullif(F.regexp_extract("titleUrl", p, 1), F.lit("")) for p in addresses])
    rows = _activity(spark, path, lines).withColumn("video", video).filter("video is not null")
    title = F.coalesce(F.nullif(F.regexp_replace(F.trim("title"), r"(?i)^Watched\s+", ""), F.lit("")), F.col("video"))
    row_name = F.concat(F.lit("yt-watch:"), "video", F.lit(":"), _iso(F.col("at")))
    return rows.select(row_name.alias("external_id"), F.lit("watched_video").alias("event_type"), F.col("at").alias("occurred_at"), title.alias("title"), F.get("subtitles", F.lit(0))["name"].alias("text"))


def search_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Searches: what was typed is title and text."""
    query = F.nullif(F.try_url_decode(F.regexp_extract("titleUrl", r"youtube\.com(?::\d+)?/results\?(?:[^#]*&)?search_query=([^&#]+)", 1)), F.lit(""))
    rows = _activity(spark, path, lines).withColumn("query", query).filter("query is not null")
    row_name = F.concat(F.lit("yt-search:"), _iso(F.col("at")), F.lit(":"), short_id("query"))
    return rows.select(row_name.alias("external_id"), F.lit("searched_youtube").alias("event_type"), F.col("at").alias("occurred_at"), F.col("query").alias("title"), F.col("query").alias("text"))


def notes(spark: SparkSession, path: str, trashed: bool = False, lines: bool = False) -> DataFrame:
    """Notes as shares: title, body, list lines and links, joined by empty lines."""
    schema = "title string, textContent string, isTrashed boolean, listContent array<struct<text:string,isChecked:boolean>>, annotations array<struct<url:string>>, userEditedTimestampUsec long, createdTimestampUsec long"
    df = _json(spark, path, lines, schema).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    told = F.filter("listContent", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    items = F.array_join(F.transform(told, lambda x: F.concat(F.when(x["isChecked"], "- [x] ").otherwise("- [ ] "), F.trim(x["text"]))), "\n")
    links = F.array_join(F.filter(F.transform("annotations", lambda a: a["url"]), lambda u: u != ""), "\n")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.concat_ws("\n\n", blank(F.col("title")), blank(F.col("textContent")), blank(items), blank(links))
    past = lambda c: F.when(F.col(c) > 0, F.col(c))
    at = F.timestamp_micros(F.coalesce(past("userEditedTimestampUsec"), past("createdTimestampUsec")))
    given = lambda c: F.nullif(F.col(c), F.lit(0).cast("long")).cast("string")
    created = F.coalesce(given("createdTimestampUsec"), given("userEditedTimestampUsec"), F.lit(""))
    rows = df if trashed else df.filter(~F.coalesce("isTrashed", F.lit(False)))
    return rows.filter(text != "").select(F.concat(F.lit("keep:"), short_id("file", created)).alias("external_id"), F.lit("note").alias("event_type"), at.alias("occurred_at"), blank(F.col("title")).alias("title"), text.alias("text"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


# What a shelf says of a book.
SHELVES = {"read": "read_book", "currently-reading": "reading_book", "to-read": "want_to_read"}


def books(spark: SparkSession, path: str) -> DataFrame:
    """Books by shelf (read where none is named); a read book by the day it was read, others by the day they were added. Rating 0 is none."""
    df = optional(_csv(spark, path), "Author", "ISBN", "ISBN13", "Private Notes", "My Review", "Date Read", "Date Added", "My Rating")
    shelf = F.coalesce(_filled("Exclusive Shelf"), F.lit("read"))
    kind = F.coalesce(*[F.when(shelf == name, event) for name, event in SHELVES.items()], F.lit("shelved_book"))
    day = lambda c: parsed_time(F.trim(c), "yyyy/MM/dd", "yyyy-MM-dd")
    at = F.coalesce(F.when(shelf == "read", day("Date Read")), day("Date Added"))
    review = F.regexp_replace(F.trim(F.coalesce("My Review", F.lit(""))), r"(?i)<br\s*/?>", "\n")
    text = F.concat_ws("\n\n", F.nullif(review, F.lit("")), F.concat(F.lit("Private notes: "), _filled("Private Notes")))
    isbn = lambda c: F.nullif(F.regexp_replace(c, "[^0-9Xx]", ""), F.lit(""))
    title = F.concat_ws(" by ", F.trim("Title"), _filled("Author"))
    rows = df.filter(at.isNotNull() & F.col("Book Id").isNotNull())
    return rows.select(F.concat_ws(":", F.lit("gr"), F.trim("Book Id"), shelf).alias("external_id"), kind.alias("event_type"), at.alias("occurred_at"), title.alias("title"), F.nullif(text, F.lit("")).alias("text"), F.coalesce(isbn("ISBN13"), isbn("ISBN")).alias("isbn"), F.nullif(F.expr("try_cast(`My Rating` AS int)"), F.lit(0)).alias("rating"))


def films(spark: SparkSession, folder: str) -> DataFrame:
    """Diary, reviews, watchlist, and watched films that the diary lacks; ratings by (name, year), the later row of two."""
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def read(name: str) -> DataFrame:
        df = optional(_csv(spark, f"{folder}/{name}.csv"), "Year", "Rating", "Review", "Watched Date", "Letterboxd URI")
        return df.withColumns({"Name": clean("Name"), "Year": clean("Year"), "Rating": F.col("Rating").try_cast("double")}).filter("Name <> ''")

    # A file of quoted lines is never split, so rows are numbered in its order; of several files the later by name counts.
    ratings = read("ratings").withColumn("place", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    ratings = ratings.groupBy("Name", "Year").agg(F.max_by("Rating", "place").alias("Rating"))
    day = lambda c: parsed_time(c, "yyyy-MM-dd")

    def events(df: DataFrame, kind: str, event: str, at: Column, text: Column, dated: bool) -> DataFrame:
        named = F.concat("Name", "Year", F.date_format("at", "yyyy-MM-dd") if dated else F.lit(""))
        title = F.when(F.col("Year") != "", F.concat("Name", F.lit(" ("), "Year", F.lit(")"))).otherwise(F.col("Name"))
        row_name = F.concat(F.lit(f"lb:{kind}:"), F.coalesce(F.nullif(F.trim("Letterboxd URI"), F.lit("")), named))
        rows = df.withColumn("at", at).filter("at is not null")
        return rows.select(row_name.alias("external_id"), F.lit(event).alias("event_type"), F.col("at").alias("occurred_at"), title.alias("title"), text.alias("text"), F.col("Rating").alias("rating"))

    none, seen_on = F.lit(None).cast("string"), F.coalesce(day("Watched Date"), day("Date"))
    diary, key = read("diary").filter(seen_on.isNotNull()), ["Name", "Year"]
    seen = read("watched").drop("Rating").join(diary.select(*key).distinct(), key, "left_anti").join(ratings, key, "left")
    out = events(diary, "diary", "watched_film", seen_on, none, True)
    out = out.unionByName(events(read("reviews").filter(clean("Review") != ""), "review", "reviewed_film", seen_on, F.trim("Review"), True))
    out = out.unionByName(events(seen, "watched", "watched_film", day("Date"), none, False))
    wanted = read("watchlist").withColumn("Rating", F.lit(None).cast("double"))
    return out.unionByName(events(wanted, "watchlist", "want_to_watch", day("Date"), none, False))


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Sports activities of a CSV whose header repeats names: the first of each counts. Numbers lose commas, 2 places."""
    lines = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    header = lines.limit(1).first()
    names: dict[str, str] = {}
    for c, n in zip(lines.columns, header or []):
        names.setdefault((n or "").strip(), c)
    col = lambda n: F.nullif(F.trim(F.col(names[n])), F.lit("")) if n in names else F.lit(None).cast("string")
    number = lambda n: F.round(F.regexp_replace(col(n), ",", "").try_cast("double"), 2)
    at = parsed_time(col("Activity Date"), "MMM d, yyyy, h:mm:ss a", "yyyy-MM-dd HH:mm:ss")
    name, kind = F.coalesce(col("Activity Name"), F.lit("")), col("Activity Type")
    title = F.when(kind.isNotNull(), F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(name)
    rows = lines.filter(at.isNotNull() & col("Activity ID").isNotNull())
    return rows.select(
        F.concat(F.lit("strava:"), col("Activity ID")).alias("external_id"),
        F.lit("workout").alias("event_type"),
        at.alias("occurred_at"),
        title.alias("title"),
        col("Activity Description").alias("text"),
        number("Distance").alias("distance"),
        number("Elapsed Time").alias("elapsed_s"),
        number("Moving Time").alias("moving_s"),
    )


def health_records(spark: SparkSession, path: str) -> DataFrame:
    """type, source, start, end, value of a health export's records, by Spark's XML reader."""
    schema = "_type string, _sourceName string, _startDate string, _endDate string, _value string"
    at = lambda c: parsed_time(c, "yyyy-MM-dd HH:mm:ss Z")
    df = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    return df.select(F.col("_type").alias("type"), F.col("_sourceName").alias("source"), at("_startDate").alias("start"), at("_endDate").alias("end"), F.col("_value").alias("value"))


# --- feeds and threads ------------------------------------------------------------------------------------------------


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS file: title, link, published_at, description."""
    df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    return df.select("title", "link", F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"), "description")


def flattened_threads(comments: DataFrame, most: int = 50) -> DataFrame:
    """thread, place, depth, line of comments (thread, id, parent, author, body, score): depth first, by score, cut, then without empty bodies.

    Levels are joined one by one until one is empty, each checkpointed; a comment's path is its ranks among its siblings,
    and sorts like a walk of the tree. Comments under an unknown parent, or in a cycle, hang on no top level and are left
    out, as in such a walk. A thread is cut to its first comments by level before it is sorted: among the first ``most`` of
    a walk no comment has a rank above ``most``."""
    checkpoints(comments.sparkSession)
    w = Window.partitionBy("thread", "parent").orderBy(F.desc("score"), "id")
    ranked = comments.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).withColumn("__rank", F.lpad(F.col("__rank").cast("string"), 8, "0"))
    level = ranked.filter("parent is null").withColumn("__path", F.col("__rank")).withColumn("depth", F.lit(0)).checkpoint()
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select("thread", F.col("id").alias("parent"), F.col("__path").alias("__above"))
        level = ranked.join(above, ["thread", "parent"]).withColumn("__path", F.concat_ws("/", "__above", "__rank")).withColumn("depth", F.lit(depth)).select(*out.columns).checkpoint()
        out = out.unionByName(level)
    place = F.row_number().over(Window.partitionBy("thread").orderBy("__path"))
    line = F.concat(F.repeat(F.lit("↳ "), F.col("depth")), F.coalesce(F.nullif("author", F.lit("")), F.lit("[deleted]")), F.lit(": "), F.col("body"))
    return out.withColumn("place", place).filter(F.col("place") <= most).filter(F.trim(F.coalesce("body", F.lit(""))) != "").select("thread", "place", "depth", line.alias("line"))


def reply_depths(posts: DataFrame) -> DataFrame:
    """(id, depth) of posts (id, in_reply_to, root): replies to the root are 1; orphans and cycles too.

    Each round doubles the way up that a post has gone, so a chain of n replies takes log2(n) joins; every round is
    checkpointed. A cycle never ends: when ways are longer than there are posts, the rest are cycles."""
    checkpoints(posts.sparkSession)
    top = F.col("in_reply_to").eqNullSafe(F.col("root"))
    ways = posts.select("id", F.when(~top, F.col("in_reply_to")).alias("up"), F.lit(1).cast("long").alias("steps"), top.alias("ended")).dropDuplicates(["id"]).checkpoint()
    most, length = ways.count(), 1
    while length <= most and not ways.filter("up is not null").isEmpty():
        above = ways.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("ended").alias("__ended"))
        moved = F.col("__ended").isNotNull()
        ways = ways.join(above, "up", "left").select("id", F.col("__up").alias("up"), F.when(moved, F.col("steps") + F.col("__steps")).otherwise(F.col("steps")).alias("steps"), F.coalesce("__ended", "ended").alias("ended")).checkpoint()
        length *= 2
    depths = ways.filter("ended").select("id", F.col("steps").cast("int").alias("depth"))
    return posts.select("id").join(depths, "id", "left").select("id", F.coalesce("depth", F.lit(1)).alias("depth"))


# --- transcripts and chats ---------------------------------------------------------------------------------------------


def subtitles(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, place, text, start, duration of SRT or WebVTT texts."""
    pattern = r"(?m)((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[ \t]*-->[ \t]*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n((?:(?!\n[ \t]*\n)[\s\S])*)"
    text = F.concat(F.regexp_replace(F.col(body), r"\r\n?", "\n"), F.lit("\n\n"))
    get = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    rows = df.select(key, F.posexplode(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("t"))).alias("place", "x"))

    def seconds(c: Column) -> Column:
        p = F.split(F.regexp_replace(c, ",", "."), ":")
        hours = F.when(F.size(p) == 3, F.get(p, F.lit(0)).cast("double")).otherwise(0.0)
        return hours * 3600 + F.get(p, F.size(p) - 2).cast("double") * 60 + F.get(p, F.size(p) - 1).cast("double")

    a, b = seconds(F.col("x.a")), seconds(F.col("x.b"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("x.t", "<[^>]+>", ""), r"\s+", " "))
    return rows.select(key, "place", clean.alias("text"), F.round(a, 3).alias("start"), F.round(F.greatest(b - a, F.lit(0.0)), 3).alias("duration")).filter("text <> ''")


def canonical_segments(segments: Column | str) -> Column:
    """array<struct<text,start,end>> to array<struct<text,start,duration>> without empty texts."""
    some = F.filter(segments, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    return F.transform(some, lambda s: F.struct(F.trim(s["text"]).alias("text"), s["start"].alias("start"), F.greatest(s["end"] - s["start"], F.lit(0.0)).alias("duration")))


# How a text export writes days, times and senders, and what it writes in place of other messages.
_DAY, _CLOCK = r"(\d{1,4}[./-]\d{1,2}[./-]\d{1,4})", r"(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?(?: ?[AaPp]\.? ?[Mm]\.?)?)"
#: [day, time] sender: text, then day, time - sender: text (a hyphen or a dash); last a line of the service itself.
CHAT_HEADERS = (
    rf"^\[{_DAY},? {_CLOCK}\] ([^:]+): ?(.*)$",
    rf"^{_DAY},? {_CLOCK} [-–—] ([^:]+): ?(.*)$",
)
SYSTEM_HEADERS = (rf"^\[{_DAY},? {_CLOCK}\] ([^:]*)$", rf"^{_DAY},? {_CLOCK} [-–—] ([^:]*)$")
#: What stands for a file that was left out, or for a message taken back.
MEDIA = r"(?i)^<[^<>]*(omitted|attached)[^<>]*>$|^(image|video|audio|sticker|gif|document|contact card) omitted$|^\S+ \(file attached\)$|^<attached: [^<>]+>$"
DELETED = r"(?i)^(this message was deleted|you deleted this message|this message was deleted by admin.*|<this message was (deleted|edited)>)\.?$"


def date_order(chat: DataFrame, by: list[str], day: str) -> DataFrame:
    """by, date_order: ymd, dmy or mdy, from the first part or second part over 12; dmy where undecided."""
    parts = F.split(F.regexp_replace(day, "[.-]", "/"), "/")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("int")
    return chat.groupBy(*by).agg(F.when(F.bool_or(F.length(a) == 4), "ymd").when(F.bool_or(a.cast("int") > 12), "dmy").when(F.bool_or(b > 12), "mdy").otherwise("dmy").alias("date_order"))


def chat_messages(lines: DataFrame, chat: str, number: str, value: str, zone: str = "UTC") -> DataFrame:
    """chat, message, sender, at, text, kind of a text export's numbered lines: a line without a header goes on with the open message.

    at is UTC; the date order is the chat's own. kind: text, media, deleted, or system for a dated line without a sender."""
    clean = F.regexp_replace(F.regexp_replace(F.col(value), "[\u200e\u200f\u202a-\u202e\ufeff]", ""), "[\u202f\u00a0]", " ")
    part = lambda i, n=0: F.coalesce(*[F.nullif(F.regexp_extract(clean, h, i), F.lit("")) for h in (*CHAT_HEADERS, *SYSTEM_HEADERS[:n])])
    w = Window.partitionBy(chat).orderBy(number)
    service = F.coalesce(*[F.nullif(F.regexp_extract(clean, h, 3), F.lit("")) for h in SYSTEM_HEADERS])
    rows = lines.select(chat, number, clean.alias("__line"), part(1, 2).alias("__day"), part(2, 2).alias("__time"), part(3).alias("__sender"), F.coalesce(part(4), F.when(part(3).isNull(), service), F.lit("")).alias("__first"))
    rows = rows.withColumn("message", F.count_if(F.col("__day").isNotNull()).over(w)).filter("message > 0")
    body = F.when(F.col("__day").isNotNull(), F.col("__first")).otherwise(F.col("__line"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, body.alias("t")))), lambda x: x["t"]), "\n")
    out = rows.groupBy(chat, "message").agg(F.max("__sender").alias("sender"), F.max("__day").alias("__day"), F.max("__time").alias("__time"), texts.alias("text"))
    out = out.join(date_order(rows.filter("__day is not null"), [chat], "__day"), chat)
    p = F.split(F.regexp_replace("__day", "[.-]", "/"), "/")
    at = lambda i: F.get(p, F.lit(i)).cast("int")
    year = F.when(F.col("date_order") == "ymd", at(0)).otherwise(at(2))
    month = F.when(F.col("date_order") == "dmy", at(1)).when(F.col("date_order") == "mdy", at(0)).otherwise(at(1))
    day = F.when(F.col("date_order") == "dmy", at(0)).when(F.col("date_order") == "mdy", at(1)).otherwise(at(2))
    year = F.when(year < 100, 2000 + year).otherwise(year)
    half = F.regexp_replace(F.upper(F.regexp_extract("__time", r"[AaPp]\.? ?[Mm]\.?$", 0)), "[^APM]", "")
    digits = F.regexp_replace(F.regexp_extract("__time", r"^\d{1,2}[:.]\d{2}([:.]\d{2})?", 0), "[.]", ":")
    stamp = F.concat(F.format_string("%04d-%02d-%02d ", year, month, day), digits, half)
    local = parsed_time(stamp, "yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd h:mm:ssa", "yyyy-MM-dd h:mma")
    kind = F.when(F.col("sender").isNull(), "system").when(F.trim("text").rlike(DELETED), "deleted").when(F.trim("text").rlike(MEDIA), "media").otherwise("text")
    return out.select(chat, "message", "sender", F.to_utc_timestamp(local, zone).alias("at"), "text", kind.alias("kind"))


def chat_shares(turns: DataFrame, chat: str, sender: str, at: str, lines: str) -> DataFrame:
    """Turns (at in UTC, lines: array of texts) as shares: those with a line that is more than a mark in brackets; the id is of chat, sender and first time."""
    told = F.exists(lines, lambda x: ~F.trim(x).rlike(r"^(\[[^\]]*\]|<[^>]*>)?$"))
    rows = turns.filter(F.coalesce(told, F.lit(False)) & F.col(sender).isNotNull())
    return rows.select(F.concat(F.lit("whatsapp:"), short_id(chat, sender, _iso(F.col(at)))).alias("external_id"), chat, sender, F.col(at).alias("occurred_at"), F.array_join(lines, "\n").alias("text"))


# --- posts of stored listings -------------------------------------------------------------------------------------------

# Where each service's JSON keeps the fields of a post.
POSTS = {
    "reddit": {"id": "$.id", "author": "$.author", "title": "$.title", "text": "$.selftext", "url": "$.permalink", "score": "$.score", "epoch": "$.created_utc"},
    "hn": {"id": "$.objectID", "author": "$.author", "title": "$.title", "text": "$.story_text", "url": "$.url", "score": "$.points", "epoch": "$.created_at_i"},
    "mastodon": {"id": "$.id", "author": "$.account.acct", "title": None, "text": "$.content", "url": "$.url", "score": "$.favourites_count", "time": "$.created_at"},
    "bluesky": {"id": "$.uri", "author": "$.author.handle", "title": None, "text": "$.record.text", "url": "$.uri", "score": "$.likeCount", "time": "$.indexedAt"},
    "twitter": {"id": "$.id", "author": "$.author_id", "title": None, "text": "$.text", "url": None, "score": "$.public_metrics.like_count", "time": "$.created_at"},
}


def posts(rows: DataFrame, service: str, value: str = "value", since=None) -> DataFrame:
    """source_type, id, author, title, text, url, score, published_at of posts stored as one JSON object a row.

    Rows without an id are left out, as are those at or before ``since``; HTML becomes its text. KeyError for an unknown service."""
    where = POSTS[service]
    get = lambda k: F.get_json_object(value, where[k]) if where.get(k) else F.lit(None).cast("string")
    at = F.timestamp_seconds(get("epoch").try_cast("decimal(18,6)")) if "epoch" in where else F.try_to_timestamp(get("time"))
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(get("text"), F.lit("")), r"(?i)<br\s*/?>|</p>", "\n"), "<[^>]+>", ""), F.lit(" \t\n\r"))
    out = rows.select(F.lit(service).alias("source_type"), get("id").alias("id"), get("author").alias("author"), get("title").alias("title"), text.alias("text"), get("url").alias("url"), get("score").try_cast("long").alias("score"), at.alias("published_at"))
    out = out.filter("id is not null")
    return out if since is None else out.filter(F.col("published_at") > F.lit(since))


def fanned_out(sources: dict[str, DataFrame], value: str = "value", since=None) -> tuple[DataFrame | None, dict[str, str]]:
    """Posts of several services in their order, and what went wrong with the services that gave none."""
    out, failed = None, {}
    for place, (service, rows) in enumerate(sources.items()):
        try:
            one = posts(rows, service, value, since).withColumn("place", F.lit(place))
        except Exception as e:  # one service's fault is not another's
            failed[service] = f"{type(e).__name__}: {e}"
            continue
        out = one if out is None else out.unionByName(one)
    return out, failed


def nested_thread(posts: DataFrame, thread: str, value: str, replies: str = "replies", deepest: int | None = None) -> DataFrame:
    """thread, id, parent, author, body, score of reply trees stored as JSON: what ``flattened_threads`` takes.

    Each round unrolls one level's replies until none has any; a blocked post keeps its place, without a text, and its replies."""
    checkpoints(posts.sparkSession)
    post = lambda j: (F.coalesce(F.get_json_object(j, "$.post.uri"), F.concat_ws("/", F.lit("blocked"), "parent", "nth")), F.get_json_object(j, "$.post.author.handle"), F.get_json_object(j, "$.post.record.text"), F.coalesce(F.get_json_object(j, "$.post.likeCount").try_cast("long"), F.lit(0)))
    level = posts.select(F.col(thread).alias("thread"), F.lit(None).cast("string").alias("parent"), F.posexplode(F.from_json(F.get_json_object(value, f"$.{replies}"), "array<string>")).alias("nth", "json")).checkpoint()
    out, depth = None, 0
    while not level.isEmpty() and (deepest is None or depth < deepest):
        names = ("id", "author", "body", "score")
        here = level.select("thread", "parent", *[c.alias(n) for n, c in zip(names, post("json"))], "json")
        rows = here.select("thread", "id", "parent", "author", "body", "score")
        out = rows if out is None else out.unionByName(rows)
        level = here.select("thread", F.col("id").alias("parent"), F.posexplode(F.from_json(F.get_json_object("json", f"$.{replies}"), "array<string>")).alias("nth", "json")).checkpoint()
        depth += 1
    return out if out is not None else level.select("thread", F.lit("").alias("id"), "parent", F.lit("").alias("author"), F.lit("").alias("body"), F.lit(0).cast("long").alias("score"))

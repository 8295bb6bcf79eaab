import hashlib
import json
import os

from pyspark.sql import functions as F

from lectern.plans import ORACLES, QUERIES
from lectern.sources import imports as im
from tests.compare import differences


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    return str(p)


def test_music_history_both_layouts(spark, tmp_path):
    long = [
        {"ts": "2024-01-02T03:04:05Z", "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "Band", "spotify_track_uri": "uri:1", "incognito_mode": False, "ip_addr": "1.2.3.4"},
        {"ts": "2024-01-02T04:04:05Z", "master_metadata_track_name": "Secret", "incognito_mode": True},
        {"ts": "2024-01-03T04:04:05Z", "episode_name": "Ep", "episode_show_name": "Show", "spotify_episode_uri": "uri:2"},
        {"ts": None, "master_metadata_track_name": "Undated"},
        {"ts": "2024-01-04T04:04:05Z"},
    ]
    got = {r.external_id: r for r in im.music_history(spark, write(tmp_path, "long.json", long)).collect()}
    assert set(got) == {"2024-01-02T03:04:05+00:00|uri:1", "2024-01-03T04:04:05+00:00|uri:2"}
    assert got["2024-01-03T04:04:05+00:00|uri:2"].event_type == "played_episode"
    assert got["2024-01-02T03:04:05+00:00|uri:1"].title == "Song — Band"
    short = [{"endTime": "2024-01-02 03:04", "artistName": "B", "trackName": "T", "msPlayed": 5}]
    row = im.music_history(spark, write(tmp_path, "short.json", short)).first()
    assert row.title == "T — B" and row.external_id == "2024-01-02T03:04:00+00:00|" + hashlib.sha1(b"T\x1fB").hexdigest()[:20]
    book = [{"ts": "2024-01-02T03:04:05Z", "audiobook_title": "Saga", "audiobook_chapter_title": "One", "audiobook_uri": "uri:3"}]
    row = im.music_history(spark, write(tmp_path, "book.json", book)).first()
    assert (row.event_type, row.title) == ("played_audiobook", "One — Saga")


def test_watch_and_search_history(spark, tmp_path):
    watch = [
        {"title": "Watched A film", "titleUrl": "https://www.youtube.com/watch?v=abcdefghijk", "time": "2024-02-01T10:00:00.123Z", "subtitles": [{"name": "Channel", "url": "u"}]},
        {"title": "Ad", "titleUrl": "https://www.youtube.com/watch?v=zzzzzzzzzzz", "time": "2024-02-01T10:00:00Z", "details": [{"name": "From Google Ads"}]},
        {"title": "Gone", "time": "2024-02-01T10:00:00Z"},
        {"title": "Other", "titleUrl": "https://host/watch?v=zzzzzzzzzzz", "time": "2024-02-01T10:00:00Z"},
        {"title": " ", "titleUrl": "https://youtu.be/kkk?t=1", "time": "2024-02-01T10:00:00Z"},
    ]
    rows = im.watch_history(spark, write(tmp_path, "w.json", watch)).collect()
    assert [(r.external_id, r.event_type, r.title, r.text) for r in rows] == [("yt-watch:abcdefghijk:2024-02-01T10:00:00.123000+00:00", "watched_video", "A film", "Channel"), ("yt-watch:kkk:2024-02-01T10:00:00+00:00", "watched_video", "kkk", None)]
    search = [{"title": "Searched for a b", "titleUrl": "https://www.youtube.com/results?search_query=a+b%20c", "time": "2024-02-01T10:00:00Z"}]
    row = im.search_history(spark, write(tmp_path, "s.json", search)).first()
    digest = hashlib.sha1(b"a b c").hexdigest()[:20]
    assert (row.external_id, row.event_type, row.title, row.text) == (f"yt-search:2024-02-01T10:00:00+00:00:{digest}", "searched_youtube", "a b c", "a b c")


def test_notes(spark, tmp_path):
    data = [{"title": "T", "textContent": "", "listContent": [{"text": "milk", "isChecked": True}, {"text": " eggs ", "isChecked": False}, {"text": " ", "isChecked": True}], "userEditedTimestampUsec": 1700000000000000}, {"title": "gone", "isTrashed": True}, {"title": " "}]
    rows = im.notes(spark, write(tmp_path, "n.json", data)).collect()
    name = hashlib.sha1("n.json\x1f1700000000000000".encode()).hexdigest()[:20]
    assert [(r.external_id, r.text) for r in rows] == [(f"keep:{name}", "T\n\n- [x] milk\n- [ ] eggs")]


def test_books_films_activities(spark, tmp_path):
    books = 'Book Id,Title,Author,ISBN,My Rating,Date Read,Date Added,Exclusive Shelf,My Review,Private Notes\n1,B1,Ann,"=""978X""",0,2024/01/02,2023/01/01,read,"a<br/>b",mine\n2,B2,,,5,,2023/05/06,to-read,,\n3,B3,,,4,,,read,,\n4,B4,,,1,,2023-05-07,lent,,\n5,B5,,,1,2024/02/03,2023-05-07,,,\n'
    got = {r.title: r for r in im.books(spark, write(tmp_path, "b.csv", books)).collect()}
    assert set(got) == {"B1 by Ann", "B2", "B4", "B5"} and got["B1 by Ann"].text == "a\nb\n\nPrivate notes: mine"
    assert got["B1 by Ann"].rating is None and got["B1 by Ann"].isbn == "978X" and got["B1 by Ann"].external_id == "gr:1:read"
    assert [got[b].event_type for b in ("B1 by Ann", "B2", "B4", "B5")] == ["read_book", "want_to_read", "shelved_book", "read_book"]
    assert str(got["B5"].occurred_at)[:10] == "2024-02-03" and got["B5"].external_id == "gr:5:read"
    films = tmp_path / "films"
    films.mkdir()
    write(films, "diary.csv", "Date,Name,Year,Rating,Watched Date\n2024-01-05,F1,2000,4,2024-01-04\n")
    write(films, "ratings.csv", "Date,Name,Year,Rating\n2024-02-01,F2,2001,2\n2024-01-01,F2,2001,3\n")
    write(films, "reviews.csv", "Date,Name,Year,Rating,Review,Watched Date\n2024-01-05,F1,2000,4,Good,2024-01-04\n2024-01-06,F3,2000,4, ,2024-01-04\n")
    write(films, "watched.csv", "Date,Name,Year\n2024-01-05,F1,2000\n2024-01-07,F2,2001\n")
    write(films, "watchlist.csv", "Date,Name,Year\n2024-03-01,F4,\n")
    got = sorted((r.external_id, r.event_type, r.title, r.rating, r.text) for r in im.films(spark, str(films)).collect())
    assert got == [
        ("lb:diary:F120002024-01-04", "watched_film", "F1 (2000)", 4.0, None),
        ("lb:review:F120002024-01-04", "reviewed_film", "F1 (2000)", 4.0, "Good"),
        ("lb:watched:F22001", "watched_film", "F2 (2001)", 3.0, None),
        ("lb:watchlist:F4", "want_to_watch", "F4", None, None),
    ]
    acts = 'Activity ID,Activity Date,Activity Name,Activity Type,Elapsed Time,Distance,Elapsed Time,Distance\n7,"Jan 5, 2024, 7:08:09 AM",Run,Run,"1,234.567",5,9,9\n,"Jan 5, 2024, 7:08:09 AM",x,y,1,1,1,1\n'
    row = im.activities(spark, write(tmp_path, "a.csv", acts)).collect()
    assert [(r.external_id, r.event_type, r.title, r.elapsed_s, r.distance) for r in row] == [("strava:7", "workout", "Run (Run)", 1234.57, 5.0)]


def test_health_and_feed(spark, tmp_path):
    xml = '<HealthData><Record type="Steps" sourceName="Phone" startDate="2024-01-01 08:00:00 +0200" endDate="2024-01-01 09:00:00 +0200" value="12"/><Record type="Sleep" sourceName="Watch" startDate="bad" endDate="bad" value="x"/></HealthData>'
    got = {r.type: r for r in im.health_records(spark, write(tmp_path, "h.xml", xml)).collect()}
    assert got["Steps"].start.hour == 6 and got["Sleep"].start is None
    rss = "<rss><channel><item><title>A</title><link>l</link><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate><description>d</description></item></channel></rss>"
    row = im.feed_items(spark, write(tmp_path, "f.xml", rss)).first()
    assert (row.title, row.published_at.year) == ("A", 2024)


def test_threads_and_reply_depths(spark):
    rows = [(1, 1, None, "a", "top", 5), (1, 2, 1, "b", "low", 1), (1, 3, 1, None, "high", 9), (1, 4, 3, "c", " ", 1), (1, 5, None, "d", "second", 4), (1, 6, 4, "e", "deep", 0)]
    df = spark.createDataFrame(rows, "thread int, id int, parent int, author string, body string, score int")
    got = [(r.depth, r.line) for r in im.flattened_threads(df).orderBy("place").collect()]
    assert got == [(0, "a: top"), (1, "↳ [deleted]: high"), (3, "↳ ↳ ↳ e: deep"), (1, "↳ b: low"), (0, "d: second")]
    assert im.flattened_threads(df, most=3).count() == 2
    posts = spark.createDataFrame([(2, 1, 1), (3, 2, 1), (4, 99, 1), (5, 6, 1), (6, 5, 1)], "id int, in_reply_to int, root int")
    assert {r.id: r.depth for r in im.reply_depths(posts).collect()} == {2: 1, 3: 2, 4: 1, 5: 1, 6: 1}


def test_subtitles_and_segments(spark):
    srt = "1\r\n00:00:01,500 --> 00:00:03,000\r\nHello\r\nthere\r\n\r\n2\r\n01:00:00,000 --> 00:59:59,000\r\n<i>End</i>\r\n"
    vtt = "WEBVTT\n\n00:05.000 --> 00:06.250 align:start\nHi\n"
    df = spark.createDataFrame([(1, srt), (2, vtt), (3, None), (4, "")], "id int, body string")
    got = sorted((r.id, r.text, r.start, r.duration) for r in im.subtitles(df, "id", "body").collect())
    assert got == [(1, "End", 3600.0, 0.0), (1, "Hello there", 1.5, 1.5), (2, "Hi", 5.0, 1.25)]
    seg = spark.sql("select array(named_struct('text',' a ','start',1D,'end',3D), named_struct('text',' ','start',3D,'end',4D)) as s").select(im.canonical_segments("s").alias("s")).first().s
    assert [(x.text, x.start, x.duration) for x in seg] == [("a", 1.0, 2.0)]


def test_chat_messages(spark):
    lines = ["[31.12.23, 23:59:01] Ann: first", "goes on", "‎[01.01.24, 00:00:02] Bob: https://x", "03.01.24, 10:00 - Ann: third"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "header"), (2, 1, "1/13/24, 1:05 PM - Cy: hi")], "chat int, n int, line string")
    kinds = ["04.01.24, 10.15 p.m. – Ann: <Media omitted>", "04.01.24, 22:16 - Bob: This message was deleted", "04.01.24, 22:17 - Ann added Bob"]
    more = spark.createDataFrame([(3, i, x) for i, x in enumerate(kinds)], "chat int, n int, line string")
    assert [(r.sender, str(r.at), r.kind) for r in im.chat_messages(more, "chat", "n", "line").orderBy("message").collect()] == [("Ann", "2024-01-04 22:15:00", "media"), ("Bob", "2024-01-04 22:16:00", "deleted"), (None, "2024-01-04 22:17:00", "system")]
    got = [(r.chat, r.sender, str(r.at), r.text) for r in im.chat_messages(df, "chat", "n", "line", "Europe/Berlin").orderBy("chat", "message").collect()]
    assert got == [(1, "Ann", "2023-12-31 22:59:01", "first\ngoes on"), (1, "Bob", "2023-12-31 23:00:02", "https://x"), (1, "Ann", "2024-01-03 09:00:00", "third"), (2, "Cy", "2024-01-13 12:05:00", "hi")]


def test_row_id_is_stable(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string").select(im.row_id("x", "y").alias("i"))
    assert len({r.i for r in df.collect()}) == 1 and F is not None


def test_reply_depths_of_a_long_chain(spark):
    chain = [(i, i - 1, 0) for i in range(1, 131)]
    odd = [(900, 901, 0), (901, 902, 0), (902, 900, 0), (903, 900, 0), (950, 999, 0), (951, 950, 0), (960, None, 0)]
    posts = spark.createDataFrame(chain + odd, "id int, in_reply_to int, root int")
    assert {r.id: r.depth for r in im.reply_depths(posts).collect()} == {**{i: i for i, _, _ in chain}, **{i: 1 for i, _, _ in odd}}


def test_threads_deeper_than_any_level_set(spark):
    rows = [(1, i, i - 1 if i > 1 else None, "a", f"t{i}", 0) for i in range(1, 131)] + [(2, 1, 2, "a", "cycle", 0), (2, 2, 1, "a", "cycle", 0)]
    df = spark.createDataFrame(rows, "thread int, id int, parent int, author string, body string, score int")
    got = im.flattened_threads(df, most=200).orderBy("place").collect()
    assert [r.depth for r in got] == list(range(130)) and {r.thread for r in got} == {1}


def test_chat_shares(spark):
    from datetime import datetime

    rows = [("c", "Ann", datetime(2024, 1, 2, 3, 4, 5), ["hi", "[image]"]), ("c", "Bob", datetime(2024, 1, 2), ["[redacted]", "<attached: x>"]), ("c", "Cy", datetime(2024, 1, 3), [])]
    got = im.chat_shares(spark.createDataFrame(rows, "chat string, sender string, at timestamp, lines array<string>"), "chat", "sender", "at", "lines").collect()
    want = hashlib.sha1("c\x1fAnn\x1f2024-01-02T03:04:05+00:00".encode()).hexdigest()[:20]
    assert [(r.external_id, r.text) for r in got] == [(f"whatsapp:{want}", "hi\n[image]")]


def test_posts_of_five_services_and_what_fails(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),), ("{}",)], "value string")
    rows = {
        "reddit": one({"id": "r1", "author": "a", "title": "T", "selftext": "body", "permalink": "/r/x", "score": 5, "created_utc": 1700000000.0}),
        "hn": one({"objectID": "7", "author": "b", "title": "H", "story_text": "<p>x</p>y", "url": "u", "points": 3, "created_at_i": 1700000001}),
        "gopher": one({}),
        "mastodon": one({"id": "m", "account": {"acct": "c"}, "content": "<p>toot</p>", "url": "u", "favourites_count": 2, "created_at": "2024-01-01T00:00:00.000Z"}),
        "bluesky": one({"uri": "at://1", "author": {"handle": "d"}, "record": {"text": "sky"}, "likeCount": 1, "indexedAt": "2024-01-02T00:00:00Z"}),
        "twitter": one({"id": "t", "author_id": "9", "text": "tw", "public_metrics": {"like_count": 4}, "created_at": "2024-01-03T00:00:00Z"}),
    }
    out, failed = im.fanned_out(rows)
    got = [(r.source_type, r.id, r.author, r.text, r.score, r.published_at.year) for r in out.orderBy("place").collect()]
    assert got == [("reddit", "r1", "a", "body", 5, 2023), ("hn", "7", "b", "x\ny", 3, 2023), ("mastodon", "m", "c", "toot", 2, 2024), ("bluesky", "at://1", "d", "sky", 1, 2024), ("twitter", "t", "9", "tw", 4, 2024)]
    assert list(failed) == ["gopher"]
    from datetime import datetime

    assert [r.source_type for r in im.fanned_out(rows, since=datetime(2024, 1, 2))[0].orderBy("place").collect()] == ["twitter"]


def test_nested_threads(spark):
    post = lambda i, likes, *replies: {"post": {"uri": i, "author": {"handle": f"h{i}"}, "record": {"text": f"t{i}"}, "likeCount": likes}, "replies": list(replies)}
    tree = {"replies": [post("a", 1, post("b", 2)), {"blocked": True, "replies": [post("c", 0)]}, post("d", 9)]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps({"replies": []})), (3, None)], "thread int, tree string")
    flat = im.nested_thread(df, "thread", "tree")
    assert {(r.id, r.parent) for r in flat.collect() if r.author} == {("a", None), ("b", "a"), ("c", "blocked/1"), ("d", None)}
    lines = [(r.depth, r.line) for r in im.flattened_threads(flat).orderBy("place").collect()]
    assert lines == [(0, "hd: td"), (0, "ha: ta"), (1, "↳ hb: tb"), (1, "↳ hc: tc")]


def test_posts_of_the_first_second_are_later_than_it(spark, tmp_path):
    """Times count to the microsecond, in the listings and where they are read."""
    rows = [(i, f"2024-01-{d}", 7, kind, v) for i, (d, kind, v) in enumerate([("10 00:00:00", "view", 1.5), ("10 00:00:00.000001", "view", -0.5), ("10 00:00:00.999999", "purchase", 2.5), ("09 23:59:59.999999", "click", 1.0), ("10 00:00:00", "purchase", 1.0)])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events"))
    os.rename(next((tmp_path / "events").glob("*.parquet")), tmp_path / "events.parquet")
    only, others, n = differences(QUERIES["stored_posts"](spark, str(tmp_path)), ORACLES["stored_posts"], str(tmp_path))
    assert (only, others, n) == ([], [], 2)

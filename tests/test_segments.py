import random
from datetime import datetime

from lectern.functions.segments import chunk_segments, packed
from lectern.functions.text import overlap_words, shingles
from lectern.functions.time import next_run_at


def item(text, start=0.0, kind=None, ref=None, atomic=False):
    return (text, start, 1.0, kind, ref, atomic)


def test_chunks_hold_whole_items_and_repeat_the_trailing_ones():
    items = [item("a b c", 0, ref="r0"), item("d e", 1, ref="r1"), item("f g h i", 2, ref="r2")]
    out = packed(items, tokens=6, overlap=2)
    assert [c[5] for c in out] == ["a b c d e", "d e f g h i"]
    assert out[0][:3] == (5, 0.0, 2.0) and out[0][4] == "r0" and out[1][4] == "r2"


def test_an_atomic_item_is_not_repeated_and_a_visual_one_does_not_lead():
    items = [item("a b", 0, atomic=True), item("v v v v", 1, kind="visual", ref="v"), item("c", 2, kind="speech", ref="s")]
    out = packed(items, tokens=6, overlap=6)
    assert [c[5] for c in out] == ["a b v v v v", "v v v v c"]
    assert out[1][3] == "speech"
    assert packed([], 6, 2) == [] and packed([item("  ")], 6, 2) == []


def test_an_item_longer_than_a_chunk_stays_whole():
    assert [c[0] for c in packed([item("a b c d e f g"), item("h")], tokens=3, overlap=1)] == [7, 1]


def test_chunk_segments_takes_null_lists(spark):
    kind = "doc long, parts array<struct<text:string,start:double,duration:double,kind:string,ref:string,atomic:boolean>>"
    df = spark.createDataFrame([(1, [("a b", 0.0, 1.0, None, None, None)]), (2, None), (3, [])], kind)
    rows = chunk_segments(df, "doc", "parts").collect()
    assert [(r.doc, r.chunk, r.total_chunks) for r in rows] == [(1, "a b", 1)]


def test_next_run_crosses_clock_changes():
    at = datetime(2026, 3, 28, 12)
    # Berlin moves from 02:00 to 03:00 on 29 March 2026.
    assert next_run_at(at, "daily", 9, 0, None, None, "Europe/Berlin") == datetime(2026, 3, 29, 7)
    assert next_run_at(at, "weekly", 9, 0, 0, None, "UTC") == datetime(2026, 3, 30, 9)
    assert next_run_at(datetime(2026, 2, 1), "monthly", 0, 30, None, 31, "UTC") == datetime(2026, 2, 28, 0, 30)


def test_shingles(spark):
    df = spark.createDataFrame([("one two three four five",), ("alpha beta",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(shingles("q", 3)).collect()] == [["one two three", "two three four", "three four five"], [], [], []]


def test_overlaps_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(2))
        most = rng.randint(0, 6)
        assert overlap_words(a, b, most) == max(n for n in range(min(most, len(a), len(b)) + 1) if a[len(a) - n :] == b[:n])

"""The index of trigrams: the rows of a scan, changes, and what is read."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators.postings import PostingIndex, followed
from lectern.operators.retrieval import bm25

WEIGHTS = {"title": 5.0, "body": 1.0}
SCHEMA = "id long, title string, body string, at long"


def some_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["apple", "pineapple", "Grape", "gr.pe", "a%b_c", "naïve", "été", "x", "ab", "abc"]
    text = lambda m: " ".join(rng.choice(words) for _ in range(rng.randint(0, m)))
    return [(i, text(3) or None, text(12), i % 7) for i in range(n)]


def found(df):
    return [(r.id, r.score) for r in df.collect()]


def built(spark, tmp_path, rows, name="index"):
    index = PostingIndex(spark, str(tmp_path / name), "id", ("title", "body"))
    df = spark.createDataFrame(rows, SCHEMA)
    index.add(df)
    return index, df


@pytest.mark.parametrize("terms", [["apple"], ["apple", "grape"], ["gr.pe"], ["%b_"], ["ÏVE"], ["nowhere"], ["pineapple", "abc", "été"]])
def test_a_search_gives_what_a_scan_gives(spark, tmp_path, terms):
    index, df = built(spark, tmp_path, some_rows(120))
    assert found(index.search(df, terms, WEIGHTS, "at")) == found(bm25(df, terms, "id", WEIGHTS, "at"))


def test_candidates_hold_a_term_or_its_rarest_trigrams(spark, tmp_path):
    rows = some_rows(200, 2)
    index, _ = built(spark, tmp_path, rows)
    got = {r.key for r in index.candidates(["pineapple"]).collect()}
    assert got == {i for i, t, b, _ in rows if "pineapple" in f"{t or ''}\n{b}".lower()}


def test_changes_are_appended_and_count_once(spark, tmp_path):
    rows = some_rows(60, 3)
    index, _ = built(spark, tmp_path, rows)
    files = lambda v: {(p, p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*.parquet") if f"version={v}" in str(p)}
    first = files(0)
    now = {r[0]: r for r in rows} | {i: (i, "fresh quince", "quince tree", 9) for i in (3, 5, 700)}
    for _ in range(2):  # the second time replaces the first
        index.add(spark.createDataFrame([now[i] for i in (3, 5, 700)], SCHEMA), 1)
    index.remove(spark.createDataFrame([(7,), (9,)], "id long"), 2)
    del now[7], now[9]
    df = spark.createDataFrame(list(now.values()), SCHEMA)
    assert files(0) == first
    for terms in (["quince"], ["apple"], ["grape", "apple"]):
        assert found(index.search(df, terms, WEIGHTS, "at")) == found(bm25(df, terms, "id", WEIGHTS, "at"))
    assert {r.key for r in index.candidates(["quince"]).collect()} == {3, 5, 700}
    again = index.rebuilt(str(tmp_path / "again"), df)
    assert found(again.search(df, ["apple"], WEIGHTS, "at")) == found(bm25(df, ["apple"], "id", WEIGHTS, "at"))
    assert spark.read.parquet(f"{again.path}/keys").count() == len(now)


def test_only_the_trigrams_own_buckets_are_read(spark, tmp_path):
    index, _ = built(spark, tmp_path, some_rows(300, 4))
    plan = index.postings(["pin", "ine"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*In\(gram", plan)
    whole = spark.read.parquet(f"{index.path}/postings")
    assert 0 < index.postings(["pin", "ine"]).count() < whole.count() / 10


def test_an_index_follows_a_stream(spark, tmp_path):
    rows = some_rows(40, 5)
    index, _ = built(spark, tmp_path, rows)
    inbox, done = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    now = {r[0]: r for r in rows}
    for n, changed in enumerate([[(1, "old plum", "x", 1), (1, "new plum", "plum", 2)], [(2, "plum", None, 3), (90, "a plum tree", "plum plum", 3)]]):
        spark.createDataFrame(changed, SCHEMA).coalesce(1).write.parquet(f"{inbox}/{n}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{inbox}/*")
        followed(stream, index, done).awaitTermination()
        now |= {r[0]: r for r in changed}
        df = spark.createDataFrame(list(now.values()), SCHEMA)
        assert found(index.search(df, ["plum"], WEIGHTS, "at")) == found(bm25(df, ["plum"], "id", WEIGHTS, "at"))


def test_short_terms_are_refused_and_an_empty_index_finds_nothing(spark, tmp_path):
    index, df = built(spark, tmp_path, [])
    with pytest.raises(ValueError):
        index.search(df, ["ab"], WEIGHTS, "at")
    assert found(index.search(df, ["abc"], WEIGHTS, "at")) == []
    assert df.filter(F.lit(True)).count() == 0


def test_a_long_text_is_indexed_in_one_pass(spark, tmp_path):
    body = "".join(random.Random(3).choice("abcdeé😀 Ñ\n") for _ in range(200_000))
    began = time.time()
    index, _ = built(spark, tmp_path, [(1, "ab", body, 1), (2, None, "a😀b", 1), (3, "", "xy", 2)])
    assert time.time() - began < 20
    rows = spark.read.parquet(f"{index.path}/postings").groupBy("key", "field").agg(F.collect_list("gram").alias("g")).collect()
    low = body.lower()
    assert {(r.key, r.field): sorted(r.g) for r in rows} == {(1, "body"): sorted({low[i : i + 3] for i in range(len(low) - 2)}), (2, "body"): ["a😀b"]}

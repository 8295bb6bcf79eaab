import pytest
from pyspark.sql import functions as F

from lectern.operators import library as op
from lectern.sources.connectors import Articles, Stored, connector_for, register

ROWS = [(1, "alpha beta", "first", 3), (1, "alpha beta", "second", 9), (2, "gamma", "ab", 5), (3, None, "AB alpha", 7)]


def table(spark):
    return spark.createDataFrame(ROWS, "id int, title string, text string, created_at int")


def test_groups_come_in_one_order_and_ids_once(spark):
    tables = {kind: table(spark) for kind in op.SEARCH_TYPES}
    got = op.grouped_search(" ab ", tables, ("qa", "documents")).collect()
    assert [(r.type, r.place, r.id) for r in sorted(got, key=lambda r: (op.SEARCH_TYPES.index(r.type), r.place))] == [("documents", 1, "3"), ("documents", 2, "2"), ("qa", 1, "3"), ("qa", 2, "2")]
    ranked = op.grouped_search("alpha", tables, ("documents",)).collect()
    assert sorted(r.id for r in ranked) == ["1", "3"] and all(r.score > 0 for r in ranked)
    assert op.grouped_search("  ", tables).count() == 0
    with pytest.raises(ValueError):
        op.grouped_search("x", tables, ("documents", "films"))


def test_an_empty_scope_of_runs_is_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "c"), (2, "b", "c")], "document_id int, title string, channel_name string")
    grants = spark.createDataFrame([(1, 7), (2, 7)], "document_id int, tenant_id int")
    assert op.library_rows(docs, grants, 7, job_ids=[]).count() == 0
    assert op.library_rows(docs, grants, 7).count() == 2 and op.library_rows(docs, grants, 8).count() == 0
    assert [r.document_id for r in op.library_rows(docs, grants, 7, search="B").collect()] == [2]


def test_verdicts(spark):
    rows = [("first", None, ["a"], None), ("same", ["a"], ["a"], 0.0), ("both", ["a"], ["b"], 0.9), ("judge", ["a"], ["b"], 0.0), ("other", ["a"], ["a"], 0.9), ("alone", None, ["a"], 0.0), ("empty", [], [], 0.1)]
    df = spark.createDataFrame(rows, "name string, x array<string>, y array<string>, d double")
    got = {r.name: (r.changed, r.decided_by) for r in op.change_verdicts(df, "x", "y", "d").collect()}
    assert got == {"first": (None, "none"), "same": (False, "agreed"), "both": (True, "agreed"), "judge": (True, "needs_judge"), "other": (False, "needs_judge"), "alone": (False, "embedding_only"), "empty": (False, "agreed")}


def test_bedtimes_either_side_of_midnight(spark):
    rows = [("2024-01-01 23:30:00", "2024-01-02 07:00:00"), ("2024-01-03 00:30:00", "2024-01-03 08:00:00"), ("2024-01-03 23:50:00", "2024-01-04 07:10:00")]
    df = spark.createDataFrame([("w", *r) for r in rows], "s string, a string, b string").select("s", *[F.col(c).cast("timestamp_ntz").alias(c) for c in "ab"])
    facts = op.sleep_facts(op.health_nights(df, "s", "a", "b", 30, 180)).first()
    assert (facts.nights, facts.median_hours_asleep, facts.typical_bedtime, facts.typical_wake_time) == (3, 7.5, "23:50", "07:10")
    naps = op.health_nights(df, "s", "a", "b", 30, 8 * 60)
    assert naps.count() == 0


def test_connectors(spark):
    rows = spark.createDataFrame([(1, "ann", 5, "Red cars"), (2, "ann", 9, "blue cars"), (3, "bob", 7, " ")], "k int, who string, at int, body string")
    register("posts", Stored(rows, "k", "who", "at", ("body",), "body"))
    c = connector_for("posts")
    assert [r.id for r in c.search("CARS red").collect()] == [1] and c.search(" ").count() == 0
    assert [r.id for r in c.list_creator_items("ann", limit=1).collect()] == [2] and [r.id for r in c.list_creator_items("ann", since=5).collect()] == [2]
    assert [r.id for r in c.fetch_text([1, 3, 99]).collect()] == [1] and c.fetch_metadata([]).count() == 0
    with pytest.raises(KeyError):
        connector_for("gopher")
    pages = spark.createDataFrame([(1, "https://a.b/x", "<title> T </title><p>body</p>"), (2, "https://c/y", "<script>x</script>")], "id int, url string, html string")
    a = Articles(pages, "id", "url", "html")
    assert [r.title for r in a.fetch_metadata(None).collect()] == ["T"] and [r.text for r in a.fetch_text([1, 2]).collect()] == ["T body"]
    assert [r.id for r in a.list_creator_items("c").collect()] == [2]

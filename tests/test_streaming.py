import random
import uuid

from pyspark.sql import functions as F

from lectern.streaming import events as st

def batch(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_ingest_is_idempotent_and_takes_late_rows(spark, tmp_path):
    src, run = tmp_path / "src", str(tmp_path / uuid.uuid4().hex)
    files = [
        [(1, "2024-01-02 00:00:00", 1, "a", 1.0, "x"), (2, "2024-01-02 00:00:00", 2, "a", 1.0, "x")],
        [(1, "2024-01-03 00:00:00", 1, "a", 5.0, "y"), (1, "2024-01-02 12:00:00", 1, "a", 4.0, "z"), (3, "2020-01-01 00:00:00", 3, "b", 0.0, "late")],
        [(2, "2024-01-02 00:00:00", 2, "a", 1.0, "x")],
    ]
    for i, rows in enumerate(files):
        batch(spark, rows).coalesce(1).write.parquet(str(src / f"f{i}.parquet"))
        got = st.ingest(st.event_stream(spark, str(src / "*"), "*.parquet"), run, ["event_id"], ["ts"], ["value", "props"])
    assert {r.event_id: (r.value, r.props) for r in got.collect()} == {1: (5.0, "y"), 2: (1.0, "x"), 3: (0.0, "late")}
    again = st.ingest(st.event_stream(spark, str(src / "*"), "*.parquet"), run, ["event_id"], ["ts"], ["value", "props"])
    assert again.count() == 3


def test_the_table_of_batches_is_what_merging_one_by_one_gives(spark):
    rng = random.Random(4)
    rows = [(b, k, rng.choice("xy"), f"{b}-{k}") for b in range(8) for k in range(20) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "batch long, key int, content string, note string")
    table = {}
    for _, k, content, note in rows:
        if k not in table or table[k][0] != content:
            table[k] = (content, note)
    assert {r.key: (r.content, r.note) for r in st.kept_rows(df, ["key"], ["content"]).collect()} == table


def test_merge_reports_changes(spark):
    old = batch(spark, [(1, "2024-01-02", 1, "a", 1.0, "x"), (2, "2024-01-02", 1, "a", 1.0, "x"), (4, "2024-01-02", 1, "a", 1.0, "x")])
    new = batch(spark, [(1, "2024-01-02", 1, "a", 1.0, "x"), (2, "2024-01-03", 1, "a", 2.0, "x"), (2, "2024-01-02", 1, "a", 9.0, "x"), (3, "2024-01-02", 1, "a", 1.0, None)])
    got = {r.event_id: (r.change, r.value) for r in st.merged_events(old, new, ["event_id"], ["ts"], ["value", "props"]).collect()}
    assert got == {1: ("unchanged", 1.0), 2: ("updated", 2.0), 3: ("added", 1.0), 4: ("kept", 1.0)}


def test_change_votes(spark, tmp_path):
    rows = [("s", "2024-01-01", ["a", "b"]), ("s", "2024-01-02", ["b", "a"]), ("s", "2024-01-03", ["a", "c"]), ("s", "2024-01-04", ["a", "c", "d"]), ("u", "2024-01-01", [])]
    df = spark.createDataFrame(rows, "search string, at string, ids array<string>").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = st.run_to_table(st.change_votes(stream, "search", "ids", "at"), str(tmp_path / "out")).orderBy("search", "at").collect()
    assert [(r.search, r.verdict) for r in got] == [("s", "first"), ("s", "unchanged"), ("s", "changed"), ("s", "similar"), ("u", "first")]


def test_scheduler_tick(spark):
    rows = [(1, True, "2024-01-01", None, 0, None), (2, True, "2024-01-01", "2024-01-01 11:55:00", 0, None), (3, True, "2024-01-01", "2024-01-01 11:00:00", 4, "failed"), (4, True, "2024-01-01", "2024-01-01 11:00:00", 1, "ok"), (5, False, "2024-01-01", None, 0, None), (6, True, "2024-01-01", "2024-01-01 11:00:00", 1, "failed")]
    df = spark.createDataFrame(rows, "id int, enabled boolean, next_run_at string, claimed_at string, failures int, result string")
    for c in ("next_run_at", "claimed_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    got = {r.id: (r.action, r.enabled, r.failures) for r in st.next_state(df, "2024-01-01 12:00:00").collect()}
    assert got == {1: ("claim", True, 0), 2: ("wait", True, 0), 3: ("disable", False, 5), 4: ("advance", True, 0), 5: ("wait", False, 0), 6: ("retry", True, 2)}


def test_index_refresh_and_duplicates(spark, tmp_path):
    index = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc int, term string")
    changed = spark.createDataFrame([(1, "x y")], "doc int, text string")
    got = st.refreshed_index(index, changed, "doc", lambda d: d.select("doc", F.explode(F.split("text", " ")).alias("term")))
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "y"), (2, "c")]
    batch(spark, [(1, "2024-01-02", 1, "a", 1.0, "x"), (1, "2024-01-02", 1, "a", 1.0, "x")]).coalesce(1).write.parquet(str(tmp_path / "d" / "e.parquet"))
    stream = st.event_stream(spark, str(tmp_path / "d" / "*"), "*.parquet")
    assert st.run_to_table(st.distinct_events(stream, "ts", "1 day", ["event_id"]), str(tmp_path / "o")).count() == 1


def test_a_ledger_counts_a_batch_once(spark, tmp_path):
    run = str(tmp_path / "run")
    for i, rows in enumerate([[(1, "2024-01-02", 1, "a", 2.0, "x"), (2, "2024-01-02", 2, "b", 1.0, "x")], [(3, "2024-01-03", 1, "a", 5.0, "x")]]):
        batch(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}.parquet"))
        got = st.summed(st.event_stream(spark, str(tmp_path / "in" / "*"), "*.parquet").select("event_type", "value"), run, ["event_type"], "value")
        assert {r.event_type: r.value for r in got.collect()} == ({"a": 2.0, "b": 1.0} if i == 0 else {"a": 7.0, "b": 1.0})
    spark.createDataFrame([("a", 5.0)], "event_type string, value double").write.mode("overwrite").parquet(f"{run}/table/batch=1")
    assert {r.event_type: r.value for r in spark.read.parquet(f"{run}/table").groupBy("event_type").sum("value").toDF("event_type", "value").collect()} == {"a": 7.0, "b": 1.0}

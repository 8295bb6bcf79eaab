"""Work that grows with the input alone: what is computed once a row, and what moves between tasks."""

import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.functions import details, text as fn
from lectern.operators import attribution, graph, library, relations, statistics
from lectern.operators.relations import jaccard
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_words_of_two_scripts_are_found_in_one_pass(spark):
    """One pattern, in place of one search for each script and word; a long word of one script is looked at once."""
    text = "aбc бα α-б бб\tжз字 字か x αα\u000b字 é́б ठα " + "か" * 50_000
    want = ["бα", "α-б", "жз字", "字か", "ठα"]
    began = time.time()
    assert one(spark, text, fn.mixed_script_words("t").alias("w"))["w"] == want
    assert time.time() - began < 20
    assert plan(QUERIES["mixed_scripts"](spark, SF)).count("RLIKE") + plan(QUERIES["mixed_scripts"](spark, SF)).count("rlike") == 0


def test_scripts_are_counted_beyond_ascii(spark):
    assert one(spark, "aé бα字字 1", *statistics.script_shares("t")).asDict() | {"latin": 0.0} == {k: {"latin": 0.0, "cyrillic": 1 / 6, "greek": 1 / 6, "han": 1 / 3}.get(k, 0.0) for k in statistics.SCRIPTS}
    assert one(spark, "aé бα字字 1", *statistics.script_shares("t"))["latin"] == 1 / 3
    assert one(spark, "abc б", fn.dominant_script("t").alias("s"))["s"] == "CYRILLIC" and one(spark, "abc", fn.dominant_script("t").alias("s"))["s"] is None
    assert "ASCII" in plan(QUERIES["script_profile"](spark, SF))


def test_first_spellings_send_no_word_of_a_list_alone(spark):
    rows = [(1, ["b", " B ", "", "a", "A"]), (1, ["c", "b", "A"]), (2, [" ", ""]), (3, None), (4, ["X", None, "x"])]
    out = library.first_of_each(spark.createDataFrame(rows, "g int, w array<string>"), ["g"], "w")
    assert {r.g: r.w for r in out.collect()} == {1: ["b", "c", "A"], 4: ["X"]}
    assert "Generate" not in plan(out)


def test_topics_of_many_words(spark):
    words = [f"w{i}" for i in range(4000)] * 2
    began = time.time()
    row = one(spark, " ".join(words), fn.topic_terms("t").alias("x"), fn.hashtags("t")[0].alias("p"), F.size(fn.topic_keys("t")).alias("n"))
    assert row.x == words[:4000] and row.p == ["w0w1", "w1w2", "w2w3", "w3w4", "w4w5"] and row.n == 4000
    assert time.time() - began < 30


def test_shingles_are_made_after_the_join(spark):
    df = spark.createDataFrame([("a b c d a B c", "A b C"), (None, None), ("a", "")], "t string, o string")
    got = [r[0] for r in df.select(fn.shingles("t", 3).alias("s"), fn.shingles("o", 3).alias("o")).select(jaccard("s", "o")).collect()]
    assert got == [1 / 4, 1.0, 1.0]
    assert "array<string>" not in "".join(x for x in plan(QUERIES["shared_shingles"](spark, SF)).splitlines() if "Exchange" in x)


def test_reassembled_many_documents_to_a_batch(spark):
    chunks = [(2, 1, "c d e"), (1, 0, "x"), (2, 0, "a b c"), (2, 0, "b a"), (3, 0, None), (2, 2, "e f")]
    out = fn.reassembled(spark.createDataFrame(chunks, "d long, i int, t string"), "d", "i", "t")
    assert {r.d: r.t for r in out.collect()} == {1: "x", 2: "a b c d e f", 3: ""}
    assert "FlatMapGroups" not in plan(out)


def test_trigrams_are_cut_from_counted_words(spark):
    out = statistics.style_profile(spark.createDataFrame([("Banana é banana",), (None,)], "t string"), [], "t")
    assert {(r.kind, r.key): r.n for r in out.collect()} == {("word", "banana"): 2, ("word", "é"): 1, ("trigram", "ban"): 2, ("trigram", "ana"): 4, ("trigram", "nan"): 2}
    assert plan(out).count("Generate") == 2 and plan(out).index("trigram") < plan(out).index("banana") if "banana" in plan(out) else plan(out).count("HashAggregate") >= 4


def test_numbers_in_words_are_worked_out_once(spark):
    """A phrase's parts are summed once, and a text that says no point is not searched for one."""
    said = "one point five and twelve hundred and third, oh five, nineteen eighty-four, fifteen thousand and two, the other ones, tenth"
    want = {"1.5", "1", "5", "1203", "05", "5", "1984", "19", "84", "15002", "10"}
    got = set(one(spark, said, details.spoken_numbers("t").alias("n"))["n"])
    assert {"1.5", "1203", "1984", "15002", "10"} <= got and not got - want - {"0"}
    # What is no number word's beginning is passed by, and no phrase's sum is computed for its bound and again for its text.
    assert str(details.number_value("t")).count("aggregate(") == 4 and details._OPENS in details.NUMBER


def test_runs_of_words_are_dropped_before_they_move(spark):
    claims = spark.createDataFrame([("a", 'he said "big red fox jumps" and "nothing here"')], "id string, t string")
    sources = spark.createDataFrame([(1, "a Big red, fox jumps. big red fox jumps"), (2, "big red fox")], "id int, t string")
    out = attribution.sources_of(claims, sources, "id", "t", "id", "t")
    assert {(r.key, r.n_sources, r.first_source) for r in out.collect()} == {("big red fox jumps", 1, 1), ("nothing here", 0, None)}
    assert "BroadcastHashJoin" in plan(out)


def test_pairs_are_counted_in_more_tasks_where_there_are_more(spark, monkeypatch):
    """No task counts before pairs are dealt, and tasks grow with the pairs: 60 rows of 20 items are 3 * 190 pairs."""
    rows = [(g, i) for g in range(3) for i in range(20)] * 2 + [(None, 1), (None, 2), (1, None)]
    monkeypatch.setattr(relations, "ROWS_A_TASK", 50)
    out = relations.pairs_within(spark.createDataFrame(rows, "g int, i int"), "g", "i", 3)
    assert {tuple(r) for r in out.collect()} == {(a, b, 3) for a in range(20) for b in range(a + 1, 20)}
    assert "12), REPARTITION_BY_NUM" in plan(out)


def test_edges_are_counted_in_more_tasks_where_there_are_more(spark, monkeypatch):
    """Every kind is dealt before it is counted, by its keys; texts are made of what is counted. Repeated rows, nulls and one common topic."""
    monkeypatch.setattr(relations, "ROWS_A_TASK", 50)
    docs = spark.createDataFrame([(d, d % 7 or None) for d in range(300)] + [(1, 1), (None, 2)], "doc long, channel long")
    topics = spark.createDataFrame([(d, 0, 1) for d in range(300)] + [(d, d, 0) for d in range(300)] + [(5, 0, 1)] + [(8, t, 2) for t in range(1, 20)] + [(9, None, 1)], "doc long, topic long, place int")
    refs = spark.createDataFrame([(d, d + 1) for d in range(300)] * 2 + [(3, 3), (3, None)], "doc long, cited long")
    out = graph.typed_edges(docs, topics, refs)
    want = {(f"doc:{d}", f"channel:{d % 7}", "published_by"): 1 for d in range(300) if d % 7}
    want |= {("doc:1", "channel:1", "published_by"): 2, (None, "channel:2", "published_by"): 1}
    want |= {(f"doc:{d}", f"doc:{d + 1}", "cites"): 2 for d in range(299)}
    want |= {(f"doc:{d}", "topic:0", "about"): 1 for d in range(1, 300)} | {("doc:0", "topic:0", "about"): 2, ("doc:5", "topic:0", "about"): 2}
    want |= {(f"doc:{d}", f"topic:{d}", "about"): 1 for d in range(1, 20) if d != 8} | {("doc:8", f"topic:{t}", "about"): 1 for t in range(1, 8)}
    # Topic 8, though twice in document 8, is in no other: after topic 0 there are seven more.
    assert {(r.source, r.target, r.kind): r.weight for r in out.collect()} == want
    text = plan(out)
    assert "7), REPARTITION_BY_NUM" in text and "13), REPARTITION_BY_NUM" in text and "hashpartitioning(source" not in text
    assert "SortMergeJoin" not in text


def test_graph_edges_deals_lineitem_before_it_is_counted(spark, monkeypatch):
    monkeypatch.setattr(relations, "ROWS_A_TASK", 1000)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    text = plan(QUERIES["graph_edges"](spark, SF))
    assert text.count(f"{-(-rows // 1000)}), REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in "".join(x for x in text.splitlines() if "hashpartitioning(l_orderkey" in x)


def test_labels_are_counted_without_a_row_for_each_document(spark):
    """Arrays and single labels give the same: documents with several rows, nulls, white space, spellings, the first documents."""
    rng = random.Random(4)
    words = ["Ab", "aB", "ab", "AB", "é", "É", " x  y ", "x y", "X\ty", "", "  ", None, "w1", "W1", "w2"]
    rows = [(g, rng.choice([None, *range(12)]), [rng.choice(words) for _ in range(rng.randint(0, 6))]) for g in ("p", "q", None) for _ in range(20)]
    rows += [("one", d, ["b", "B", "b"]) for d in range(30)] + [("p", 1, None), ("r", 1, None), ("r", 2, ["", None])]
    shown = lambda df, c, **k: sorted(tuple(r) for r in statistics.label_counts(df, "d", c, ["g"], 3, 4, **k).collect())
    got = shown(spark.createDataFrame(rows, "g string, d int, w array<string>"), "w")
    single = [(g, d, w) for g, d, ws in rows for w in ws or []]
    assert got == shown(spark.createDataFrame(single, "g string, d int, w string"), "w")
    found = defaultdict(lambda: (Counter(), set()))
    for g, d, w in single:
        if g and w and (w := " ".join(w.split())):
            found[g, w.lower()][0][w] += 1
            found[g, w.lower()][1].add(d)
    want = []
    for group in {g for g, _ in found}:
        keys = sorted((k for g, k in found if g == group), key=lambda k: (-len(found[group, k][1] - {None}), k))
        for rank, key in enumerate(keys[:3], 1):
            spelt, docs = found[group, key]
            label = min(spelt, key=lambda w: (-spelt[w], -sum("A" <= c <= "Z" for c in w), w))
            # A document without an id comes first and is not listed.
            first = [d for d in sorted(docs, key=lambda d: -1 if d is None else d)[:4] if d is not None]
            want.append((group, rank, key, label, len(docs - {None}), first))
    assert got == sorted(want) and ("one", 1, "b", "b", 30, [0, 1, 2, 3]) in got


def test_no_label_moves_for_each_document(spark, monkeypatch):
    """What is counted first is counted by label alone, not by document and label; texts are read for nothing but their labels."""
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("doc"), F.array(F.lit("a"), F.lit("b"), F.lit("A")).alias("w"))
    counted, checkpoint = [], type(rows).checkpoint
    monkeypatch.setattr(type(rows), "checkpoint", lambda df, *a: counted.append(plan(df)) or checkpoint(df, *a))
    out = statistics.label_counts(rows, "doc", "w", ["g"])
    assert [tuple(r)[1:5] for r in out.orderBy("rank").collect()] == [(1, "a", "A", 1000), (2, "b", "b", 1000)]
    moved = [x for x in counted[0].splitlines() if "hashpartitioning" in x]
    assert len(counted) == 1 and moved and not [x for x in moved if "doc#" in x]

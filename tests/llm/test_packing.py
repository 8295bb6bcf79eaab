import random

from pyspark.sql import functions as F

from lectern.llm.packing import CAPACITIES, best_fit, best_fit_texts, cost, pack


def naive(lengths, sizes):
    """The same rules, looking through all open sequences and all pieces left every time."""
    bins, where = [], {}
    todo = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for at, i in enumerate(todo):
        n = lengths[i]
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n]
        if fits:
            k = min(fits)[1]
        else:
            choices = []
            for c in sizes:
                held = n
                for j in todo[at + 1 :]:
                    if held + lengths[j] <= c:
                        held += lengths[j]
                if n <= c:
                    choices.append((cost(min(x for x in sizes if x >= held)) / held, c))
            bins.append({"room": min(choices)[1], "used": 0})
            k = len(bins) - 1
        where[i] = (k, bins[k]["used"])
        bins[k]["room"] -= n
        bins[k]["used"] += n
    return where, {k: min(c for c in sizes if c >= b["used"]) for k, b in enumerate(bins)}


def test_pack_against_a_plain_search():
    rng = random.Random(3)
    for sizes in (CAPACITIES, (16, 32), (10,)):
        for n in (0, 1, 2, 40, 400):
            lengths = [rng.choice([1, 5, max(sizes), rng.randint(1, max(sizes))]) for _ in range(n)]
            sequence, offset, final = pack(lengths, sizes)
            where, last = naive(lengths, sizes)
            assert {i: (s, o) for i, (s, o) in enumerate(zip(sequence, offset))} == where and final == last


def test_the_length_opened_depends_on_what_is_left():
    """A piece of 600 gets 1024 where small pieces fill it up, and 2048 where the rest is of 700."""
    assert pack([600, 400, 24])[2] == {0: 1024}
    assert set(pack([700, 700, 640])[2].values()) == {2048}


def test_one_long_document_is_spread_over_blocks(spark):
    """300,000 words at sequences of 16 are 18,750 pieces; so are as many rows without an id."""
    for rows in ([(1, "w " * 300_000)], [(None, "w " * 16)] * 18_750):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = best_fit(df, capacities=(8, 16), block=500)
        sizes = [r["count"] for r in out.groupBy(F.substring_index("sequence_id", "-", 1)).count().collect()]
        assert sum(sizes) == 18_750 and max(sizes) < 1000


def test_table(spark):
    rows = [(i, "w " * (i * 7 % 90)) for i in range(300)] + [(None, "a b"), (5, "x " * 2500), (5, "x " * 2500), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n", "3 as piece")
    out = best_fit(df, capacities=(64, 128, 1000), block=50)
    got = out.collect()
    assert sum(r.piece_length for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert sum(1 for r in got if r.piece_length == 0) == sum(1 for _, t in rows if not (t or "").split())
    by = {}
    for r in got:
        if r.sequence_id:
            by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.piece_length for x in rs[:i]) for i in range(len(rs))]
        used = sum(r.piece_length for r in rs)
        assert {r.sequence_length for r in rs} == {min(c for c in (64, 128, 1000) if c >= used)}
    assert sorted(r.piece_start for r in got if r.doc_id == 5 and r.piece_length > 40) == [0, 0, 1000, 1000, 2000, 2000]
    assert best_fit(df.limit(0)).count() == 0
    given = best_fit(df.filter("doc_id < 5"), length=F.lit(3)).agg(F.sum("piece_length")).first()[0]
    assert given == 15


def test_any_layout_gives_the_same_placements(spark):
    rows = [(i % 140, "w " * (i * 7 % 50)) for i in range(150)] + [(None, "a b")] * 5 + [(7, "x " * 40)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = lambda d: sorted(map(str, best_fit(d, capacities=(64, 128), block=40).collect()))
    assert placed(df.repartition(1)) == placed(df.repartition(7)) == placed(df.orderBy(F.desc("text")))


def test_sequences_hold_token_ids(spark):
    from tokenizers import Tokenizer

    from lectern.llm.token_store import tokenizer_path

    texts = {1: "Zażółć gęślą jaźń, naïve 12,345.6 " * 900, 2: "日本語テキスト" * 3000, 3: "a b c", 4: None, 5: " \n"}
    library = Tokenizer.from_file(tokenizer_path())
    ids = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = best_fit_texts(df).collect()
    assert {i: sum(r.piece_length for r in got if r.doc_id == i) for i in texts} == {i: n and n + 1 for i, n in ids.items()}
    assert sum(r.doc_id == 2 for r in got) == -(-(ids[2] + 1) // max(CAPACITIES)) > 1
    used = {}
    for r in got:
        if r.sequence_id:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.piece_length
    assert all(used[r.sequence_id] <= r.sequence_length <= max(CAPACITIES) for r in got if r.sequence_id)
    assert {r.doc_id for r in got if r.sequence_id is None} == {4, 5}


def test_the_pipeline_packs_token_ids(spark):
    import corpus_pipeline as p

    rows = [(i, "日本語" * 40, "cjk") for i in range(30)] + [(100 + i, "the of and " * 40, "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert p.mixing_stage(spark, df, "").groupBy("source").count().filter("count >= 30").count() == 2
    want = {r.doc_id: r.n for r in best_fit_texts(df).groupBy("doc_id").agg(F.sum("piece_length").alias("n")).collect()}
    assert {r.doc_id: r.n for r in p.packing_stage(spark, df, "").groupBy("doc_id").agg(F.sum("piece_length").alias("n")).collect()} == want
    assert want[0] > 40 and want[100] == 121

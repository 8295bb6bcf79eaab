import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import graph, ordering, retrieval


def test_numbered_and_even_batches(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 400) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(7)
    got = {r.id: r.row for r in ordering.numbered(df, F.desc("v"), F.asc("id")).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-values[i], i)))}
    assert ordering.numbered(df.limit(0), F.asc("v")).count() == 0
    sizes = ordering.even_batches(df, [F.asc("v"), F.asc("id")], 1000, size=90).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [84] * 4 + [83] * 8
    winners = ordering.batch_winners(ordering.even_batches(df, [F.asc("id")], 1000, size=500), [F.desc("v"), F.asc("id")], 2).collect()
    best = lambda ids: sorted(ids, key=lambda i: (-values[i], i))[:2]
    assert sorted(r.id for r in winners) == sorted(best(range(500)) + best(range(500, 1000)))


def test_greedy_batches_and_gaps_against_loops(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0, 1, 5, 30, 70])) for g in range(6) for i in range(rng.randint(1, 60))]
    want, state = {}, {}
    for g, i, c in rows:
        total, batch = state.get(g, (0, 0))
        if total > 0 and total + c > 60:
            total, batch = 0, batch + 1
        state[g] = (total + c, batch)
        want[g, i] = batch
    df = spark.createDataFrame(rows, "g int, i int, c int")
    assert {(r.g, r.i): r.batch for r in ordering.greedy_batches(df, ["g"], ["i"], "c", 60).collect()} == want
    times = ordering.min_gap(df.withColumn("t", F.col("i").cast("double")), ["g"], "t", 4, 3).filter("g = 0").orderBy("place").collect()
    n = sum(g == 0 for g, _, _ in rows)
    assert [r.t for r in times] == [float(x) for x in range(0, n, 4)][:3]


def test_even_split_against_dealing_one_at_a_time(spark):
    def deal(sizes, total):
        share, rest = divmod(total, len(sizes))
        out = [min(n, share + (i < rest)) for i, n in enumerate(sizes)]
        while sum(out) < min(total, sum(sizes)):
            for i, n in enumerate(sizes):
                if sum(out) < min(total, sum(sizes)) and out[i] < n:
                    out[i] += 1
        return out

    rng = random.Random(3)
    groups = [[rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    df = spark.createDataFrame([(g, f"k{i}", n) for g, sizes in enumerate(groups) for i, n in enumerate(sizes)], "g int, kind string, n int")
    for total in (0, 1, 7, 25):
        got = ordering.even_split(df, ["g"], "kind", "n", total).orderBy("g", "kind").collect()
        assert [r.share for r in got] == [x for sizes in groups for x in deal(sizes, total)]


def test_capped_pairs_against_the_greedy_walk(spark):
    rng = random.Random(4)
    rows = [(g, a, b, rng.randint(1, 6)) for g in range(3) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.7]
    want, used = set(), {}
    for g, a, b, w in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if used.get((g, a), 0) < 3 and used.get((g, b), 0) < 3:
            used[g, a], used[g, b] = used.get((g, a), 0) + 1, used.get((g, b), 0) + 1
            want.add((g, a, b, w))
    df = spark.createDataFrame(rows, "graph int, x int, y int, n int")
    assert {tuple(r) for r in graph.capped_pairs(df, "x", "y", "n", 3).collect()} == want
    assert graph.capped_pairs(df.limit(0), "x", "y", "n").count() == 0


def test_components_of_a_chain_and_a_self_link(spark):
    chain = list(range(50))
    random.Random(5).shuffle(chain)
    df = spark.createDataFrame([*zip(chain, chain[1:]), (99, 99), (70, 60)], "a int, b int")
    got = {r.node: r.component for r in graph.components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in chain}, 99: 99, 60: 60, 70: 60}


def test_components_of_a_rising_chain_take_few_rounds(spark):
    n, store = 3000, spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")
    assert graph.components(df, "a", "b").filter("component <> 0").count() == 0
    assert store.executionsList().size() - before < 80


def test_chosen_nodes_and_capped_subgraphs(spark):
    degree = spark.createDataFrame([("a", 1), ("b", 9), ("c", 9), ("d", 9)], "node string, degree int")
    recency = spark.createDataFrame([("b", 5), ("c", 7)], "node string, at int")
    nodes = graph.chosen_nodes(degree, recency, ["a"], 3)
    assert [r.node for r in nodes.collect()] == ["a", "c", "b"]
    edges = spark.createDataFrame([("a", "b"), ("a", "d"), ("c", "d")], "x string, y string")
    found, kept, facts = graph.capped_subgraph(edges, "x", "y", degree.orderBy("node").select("node"), 2)
    assert [tuple(r) for r in found.collect()] == [("a", "b")] and kept.count() == 2
    assert facts == {"total_nodes": 4, "total_edges": 3, "truncated": True}


def vectors(n, groups, seed):
    rng = np.random.RandomState(seed)
    return [(i, i % groups, [float(x) for x in rng.normal(size=6)]) for i in range(n)]


def test_mmr_against_a_loop(spark):
    rows = vectors(40, 2, 1)
    df = spark.createDataFrame(rows, "id int, g int, v array<double>").withColumn("score", F.col("v")[0])
    asked = spark.createDataFrame([(0, rows[4][2])], "g int, v array<double>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    for g in (0, 1):
        left = {i: v for i, x, v in rows if x == g and not (g == 0 and cos(v, rows[4][2]) >= 0.88)}
        like = dict.fromkeys(left)
        for place in (1, 2, 3, 4):
            if not left:
                break
            best = min(left, key=lambda i: (-(0.65 * left[i][0] - 0.35 * (like[i] or 0.0)), -left[i][0], i))
            want.append((g, best, place))
            t = left.pop(best)
            like = {i: cos(v, t) if like[i] is None else max(like[i], cos(v, t)) for i, v in left.items()}
            left = {i: v for i, v in left.items() if like[i] < 0.5}
    got = retrieval.mmr(df, ["g"], "id", "v", "score", k=4, same=0.5, asked=asked)
    assert sorted((r.g, r.id, r.place) for r in got.collect()) == sorted(want)


def test_centroid_spread_against_numpy(spark):
    rows = vectors(300, 2, 2)
    df = spark.createDataFrame(rows, "id int, g int, v array<double>").repartition(5)
    got = {r.g: r.spread for r in retrieval.centroid_spread(df, ["g"], "v", "id").collect()}
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    for g in (0, 1):
        mine = [(np.array(v), np.random.RandomState((hashes[i] ^ 7) & 0xFFFFFFFF).poisson(1.0, 50)) for i, x, v in rows if x == g]
        whole = sum(v for v, _ in mine)
        spreads = [1 - c @ whole / np.linalg.norm(c) / np.linalg.norm(whole) for c in (sum(v * t[r] for v, t in mine) for r in range(50))]
        assert abs(got[g] - np.mean(spreads)) < 1e-9


def test_nearest_with_blocks_ties_and_zero_vectors(spark, monkeypatch):
    rows = [(i, v) for i, _, v in vectors(60, 1, 3)] + [(100, [0.0] * 6), (101, None), (102, [1.0] * 6), (103, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 256)
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in retrieval.nearest(df, df.filter("vec_id % 20 = 0 or vec_id = 102"), k=4).collect()}
    v = {i: np.array(x) for i, x in rows if x is not None}
    for q in (0, 20, 40, 100, 102):
        d = lambda i: 1.0 if not np.linalg.norm(v[q]) * np.linalg.norm(v[i]) else round(1 - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i]), 9)
        want = sorted([(d(i), i) for i in v if i != q] + [(1.0, 101)])[:4]
        assert [(round(got[q, n][1], 9), got[q, n][0]) for n in range(1, 5)] == [(round(x, 9), i) for x, i in want]


def test_bm25_without_long_terms(spark):
    df = spark.createDataFrame([(1, "ab cd", 5), (2, "ab", 9), (3, "AB CD", 7)], "id int, t string, at int")
    assert [(r.id, r.score) for r in retrieval.bm25(df, ["ab", "cd"], "id", {"t": 1.0}, "at").collect()] == [(3, 0.0), (1, 0.0)]
    assert retrieval.bm25(df, [], "id", {"t": 1.0}, "at").count() == 0

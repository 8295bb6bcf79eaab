import random

import numpy as np
import pyarrow as pa

from lectern.llm import near_dedup
from lectern.llm.common import documents
from lectern.llm.near_dedup import _parities, connected_components, near_duplicates


def brute(rows, k, percent):
    def shingles(t):
        w = [x.lower() for x in (t or "").encode().split()]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((rng.randrange(10**9) if len(rows) % 2 else -len(rows), " ".join(w)))
    rows += [(10**10, None), (10**10 + 1, ""), (10**10 + 2, " \t"), (10**10 + 3, "One"), (10**10 + 4, "one"), (10**10 + 5, "É"), (10**10 + 6, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as bucket", "'x' as digest")
    for k in (2, 5):
        assert as_dict(near_duplicates(df, shingle=k)) == brute(rows, k, 80)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (None, "x y")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, shingle=2).collect()), key=str)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (None, 0, None, True), (None, 1, None, True), (None, 3, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_id_over_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (3, a + " end")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df, shingle=2).collect())
    assert got == [(1, 59, 1, True), (1, 59, 1, True), (2, 60, 1, False), (3, 60, 1, False)]


def test_ties_and_a_very_long_text(spark):
    """Two stars as good as each other, and a text of 400,000 words with a copy that lacks its last tenth."""
    long = [f"w{i * 7919 % 100_003}" for i in range(400_000)]
    rows = [(9, " ".join(long)), (8, " ".join(long[:360_000])), (1, "a b c d e f g h i j k l"), (2, "b c d e f g h i j k l m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_duplicates(df, shingle=2)) == brute(rows, 2, 80)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = list(range(60))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(500, 100 + i) for i in range(40)] + [(7000, 6999), (6999, 7000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{i: 100 for i in [500, *range(100, 140)]}, 6999: 6999, 7000: 6999}


def joined_rows(spark, sql_ids):
    """The most rows that one join of the queries made since then."""
    return made_rows(spark, sql_ids, "Join")


def made_rows(spark, sql_ids, kind):
    """The most rows that one node of this kind made since then."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, runs = 0, store.executionsList()
    for i in range(runs.size()):
        one = runs.apply(i).executionId()
        if one in sql_ids:
            continue
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if kind not in node.name():
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    most = max(most, int(values.get(metric.accumulatorId()).get().replace(",", "")))
    return most


def test_a_group_of_5000_near_copies_and_as_many_outsiders(spark):
    """Rows grow with the group, not with its square: 5,000 copies with 2 words changed, 2,500 with a fifth changed."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(20_000)]
    base, rows = [rng.choice(words) for _ in range(100)], []
    for i in range(7500):
        w = list(base)
        for j in rng.sample(range(100), 2 if i < 5000 else 20):
            w[j] = rng.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    got = as_dict(near_duplicates(df, shingle=2))
    assert {c for i, (_, c, _) in got.items() if i < 5000} == {0}
    assert sum(c == i for i, (_, c, _) in got.items() if i >= 5000) > 2000
    assert joined_rows(spark, before) < 100 * len(rows)


def test_texts_of_one_template(spark):
    """100 words with 20 slots of 4 values: nearly all pairs share a bucket, hardly any is linked. No join, and no block, makes
    three times the rows for twice the documents; the components are those of the exact rule."""
    rng = random.Random(9)
    template, values = [f"t{i}" for i in range(100)], [[f"s{i}v{v}" for v in range(4)] for i in range(20)]
    rows = []
    for i in range(1600):
        w = list(template)
        for k in range(20):
            w[5 * k + 2] = rng.choice(values[k])
        rows.append((i, " ".join(w)))
    made = []
    for n in (800, 1600):
        store = spark._jsparkSession.sharedState().statusStore()
        before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
        got = as_dict(near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(4), shingle=2))
        made.append(joined_rows(spark, before))
        if n == 800:
            assert got == brute(rows[:n], 2, 80)
    assert made[1] < 3 * made[0] and made[1] < 100 * 1600


def test_recall_against_the_exact_rule(spark):
    """Of the pairs that the exact rule links among the documents of sf0.001, all are in one component."""
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        assert as_dict(near_duplicates(df, shingle=k)) == brute(rows, k, 80)


def test_rows_of_contested_buckets_grow_with_the_documents(spark):
    """Families of texts that differ from each other in a fifth of their shingles or a little more: each bucket a text shares is a row,
    not each of its rare shingles for each size in reach (50 to 300 a text), and pairs that cannot be linked stay in their blocks."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(50_000)]
    rows = []
    for g in range(20):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(40):
            w = list(base)
            for j in rng.sample(range(300), rng.choice([4, 14, 16])):
                w[j] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    assert as_dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows, 5, 80)
    assert made_rows(spark, before, "Generate") <= 48 * len(rows) and joined_rows(spark, before) <= 48 * len(rows)
    assert made_rows(spark, before, "MapInArrow") <= 2 * len(rows)


def test_parities_never_pass_by_a_linked_pair():
    rng = np.random.RandomState(4)
    for percent, n in [(80, 5), (80, 400), (90, 30_000)]:
        a = rng.randint(0, 1 << 62, n).astype(np.uint64)
        for kept in range(n, max(0, n * percent // 100 - 3), -max(1, n // 40)):
            b = np.r_[a[:kept], rng.randint(0, 1 << 62, n - kept).astype(np.uint64)]
            linked = 100 * kept >= percent * (2 * n - kept)
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([np.unique(x).tobytes() for x in (a, b)])], ["name", "shingles"])
            x, y = (np.frombuffer(p, np.uint64) for p in next(iter(_parities([batch]))).column(1).to_pylist())
            assert not linked or (100 + percent) * np.bitwise_count(x ^ y).sum() <= (100 - percent) * 2 * n


def test_long_buckets_go_by_rare_shingles(spark, monkeypatch):
    """The same components where buckets are longer than a block: the exact rule's, for the few blocks of small ones."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 6, 12])):
            w[j] = rng.choice(words)
        rows.append((i, " ".join(w)))
    met = []
    whole = near_dedup._prefix_pairs
    monkeypatch.setattr(near_dedup, "SLICE", 16)
    monkeypatch.setattr(near_dedup, "_prefix_pairs", lambda *a: met.append(1) or whole(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(near_duplicates(df, shingle=2)) == brute(rows, 2, 80)
    assert met

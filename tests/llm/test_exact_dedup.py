import hashlib
import random
import re

from pyspark.sql import functions as F

from lectern.llm.exact_dedup import deduplicated, grouped
from lectern.llm.queries import ORACLES, QUERIES
from tests.compare import differences


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text)."""
    found = {}
    for i, t in rows:
        found.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        c = re.sub("[\x20\x09-\x0d]", "", t or "")
        best = min(found[c], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(found[c]), i == best[2] and len(t or "") == -best[0], hashlib.sha256(c.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed=4, n=400):
    rng = random.Random(seed)
    texts = ["abc", "ab c", " a\tbc\r\n", "a\x0bb\x0cc", "abcd", "", " ", None, "é à", "éà", "é", " abc", "x" * 200_000, "x" * 100_000 + " " + "x" * 100_000]
    rows = [(rng.randrange(-1000, 1000), rng.choice(texts)) for _ in range(n)]
    return rows + [(None, "abc"), (None, "only here"), (None, "only  here"), (7, "twice"), (7, "twice"), (7, "twi ce "), (-(1 << 63), "tw ice "), (0, "tw ice ")]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_against_brute_force_and_in_any_layout(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as content", "3 as best", "4 as salt", "5 as row_id", "6 as n")
    for parts in (1, 7):
        assert got(grouped(df.repartition(parts))) == brute(rows)


def test_a_digest_that_collides_changes_nothing(spark):
    rows = some_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for weak in (lambda c: F.lit("same"), lambda c: F.char_length(c).cast("string")):
        assert got(grouped(df, digest=weak, salts=3)) == brute(rows)


def test_large_and_small_groups_take_two_ways(spark):
    """With many = 4 groups of over a quarter of the rows are broadcast; with many = 10**9 all are, with 1 none."""
    rows = [(i, "hot copy" if i % 3 else f"text {i // 30}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for many in (1, 4, 10**9):
        assert got(grouped(df, many=many)) == brute(rows)


def test_rows_that_stay(spark):
    rows = some_rows(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as __digest", "1 as __row", "2 as `a.b`", "3 as __named")
    kept = deduplicated(df)
    assert kept.columns == df.columns
    want = {(i, len(t or ""), hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()) for i, t in rows}
    best = {}
    for i, n, h in want:
        best[h] = min(best.get(h, (1, 1, 1)), (-n, i is None, i or 0))
    found = sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert found == sorted(best.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert grouped(df).count() == 0 and deduplicated(df).count() == 0


def test_query_gives_what_its_sql_gives(spark):
    name = "op13_exact_dedup"
    ours, theirs, rows = differences(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")
    assert not ours and not theirs and rows

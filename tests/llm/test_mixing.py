import math

from pyspark.sql import functions as F

from lectern.llm.mixing import exponent, mixed_rows, plan


def table(spark):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 == 0 else f"s{i % 5}") for i in range(600)]
    rows += [(1000, None, None), (1001, "", "empty"), (None, "a b c", "s1"), (1002, "a b", "s1"), (1002, "a b", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as block", "2 as epoch", "3 as tokens")


def test_every_document_once_and_small_sources_more(spark):
    df = table(spark)
    got = plan(df).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    total = {}
    for r in df.collect():
        total[r.source or ""] = total.get(r.source or "", 0) + math.ceil(len((r.text or "").strip().encode()) / 2.75)
    spent = {}
    for r in got:
        spent[r.source] = spent.get(r.source, 0) + r.n_tokens
    assert spent["big"] == total["big"]
    for s in ("s0", "s1", "s2", "s3", "s4"):
        assert total[s] <= spent[s] <= 2.0 * total[s] + 1e-6
    rates = {s: spent[s] / total[s] for s in total if total[s]}
    assert max(rates.values()) > 1.8
    assert abs(sum({r.source: r.weight for r in got}.values()) - 1) < 1e-9


def test_exponent_meets_the_entropy(spark):
    tokens = [1000, 300, 200, 50, 7]
    src = spark.createDataFrame([(f"s{i}", t, float(sum(tokens))) for i, t in enumerate(tokens)], "source string, tokens long, total double")
    for target in (1.2, 1.4, 1.55):
        a = exponent(src, target_entropy=target)
        w = [(t / sum(tokens)) ** a for t in tokens]
        p = [x / sum(w) for x in w]
        assert abs(-sum(x * math.log(x) for x in p) - target) < 1e-5


def test_the_rounded_exponent_keeps_the_limit(spark):
    """No source is repeated more than max_epochs times, at many sizes where six places round down by themselves."""
    for seed in range(4):
        tokens = [10**9 + 7 * seed, 10**6 + seed * 31, 3 * 10**4 + seed, 997 * (seed + 1)]
        src = spark.createDataFrame([(f"s{i}", t, float(sum(tokens))) for i, t in enumerate(tokens)], "source string, tokens long, total double")
        a = exponent(src, max_epochs=2.0)
        rates = [(t / sum(tokens)) ** a / t for t in tokens]
        assert max(rates) / min(rates) <= 2.0 and 0 < a < 1


def test_budget_order_and_rows(spark):
    df = table(spark)
    got = plan(df, budget=900.0, max_epochs=1.5).collect()
    assert 850 <= sum(r.n_tokens for r in got) <= 900
    for key in {(r.source, r.epoch) for r in got}:
        rows = [r for r in got if (r.source, r.epoch) == key]
        assert len({(r.block_rank, r.slot) for r in rows}) == len(rows)
    out = mixed_rows(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in df.collect()}
    assert plan(df.limit(0)).count() == 0 and mixed_rows(df.limit(0)).count() == 0

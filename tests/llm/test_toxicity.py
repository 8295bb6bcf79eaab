import random
import zlib

import numpy as np
import pytest

from lectern.llm import toxicity
from lectern.llm.queries import op6_toxic_segments


def brute_segments(s, lo=0):
    """The best contiguous run, then the same left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return brute_segments(s[:i], lo) + [(lo + i, lo + j, best[0])] + brute_segments(s[j:], lo + j)


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.choice([-0.5, -0.5, rng.uniform(-4, -0.6), rng.uniform(0.1, 3)]) for _ in range(rng.randint(0, 30))]
        at = [i for i, x in enumerate(s) if x != -0.5]
        got = sorted(toxicity.segments(at, [s[i] for i in at]))
        want = sorted(brute_segments(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_lambda_is_the_root():
    shares, scores = np.array([0.001, 0.0004]), np.array([4.0, 6.0])
    x = toxicity._lambda(shares, scores)
    assert x > 0 and abs(shares @ np.exp(x * scores) + (1 - shares.sum()) * np.exp(-x * toxicity.DRIFT) - 1) < 1e-9


def test_chance_counts_the_segments_of_shuffled_text():
    scores = sorted([3.0, 4.0, 5.0, 6.0])
    k = toxicity._chance(1000, scores, 2.0)
    assert abs(k * 1000 * np.exp(-2.0 * 5.0) - 2) < 1e-9 and toxicity._chance(1000, [], 2.0) == toxicity.CHANCE


def test_log_odds_of_both_signs(spark):
    """The lexicon against counts by hand: a token of toxic texts, one of the others, and one of both."""
    texts = [(i, ("vile " if i < 40 else "kind ") + f"word{i} both") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    prior = toxicity.LEAST + toxicity.PRIOR * 40 / 80
    top = 40 + 2 * toxicity.LEAST + toxicity.PRIOR
    odds = np.log((40 + prior) / (top - 40 - prior)) - np.log(prior / (top - prior))
    assert set(model.lexicon) == {"vile", "kind"} and abs(model.lexicon["vile"] - odds) < 1e-6 and abs(model.lexicon["kind"] + odds) < 1e-6


def test_held_out_accuracy_and_passages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op6_toxic_segments(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.9
    assert np.mean([got[i].predicted for i in held if not labels[i]]) <= 0.05


@pytest.mark.parametrize("value", [None, 0])
def test_edge_rows(spark, value):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(1, value), (None, value)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.passages(docs, model).collect()
    assert len(rows) == 4 and all(r.score < 0.3 and r.passages == [] for r in rows)
    assert toxicity.passages(docs.limit(0), model).count() == 0
    planted = toxicity.Model({"vile": 6.0}, 2.0, 1.0, -3.0)
    texts = spark.createDataFrame([(1, "x " * 30 + "vile, VILE and vile! " + "y " * 30)], "doc_id long, text string")
    row = toxicity.passages(texts, planted).first()
    assert [(p.start, p.end) for p in row.passages] == [(30, 34)] and row.score > 0.9

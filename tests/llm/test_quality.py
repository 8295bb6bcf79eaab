import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality
from lectern.llm.queries import op4_quality_classifier


def bucket(h):
    h %= 1 << 64
    h = (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % (1 << 64)
    return 1 + (h >> 32) % (quality.BUCKETS - 1)


def word_buckets(word):
    marked, base = [ord(c) for c in f"<{word}>"], 0x100000001B3
    out = [bucket(sum(c * base ** (i + 1) for i, c in enumerate(marked)))]
    for n in (3, 4):
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = h * base + c
            out.append(bucket(h))
    return out


def brute_features(text):
    words = (text or "").split()
    return [b for w in words for b in word_buckets(w)] + [quality.REPEAT for a, b in zip(words, words[1:]) if a == b]


def brute_logit(text, model):
    """Feature by feature, without memo or folding by word."""
    f = brute_features(text)
    return model[1] + (sum(float(model[0][b]) for b in f) / len(f) if f else 0.0)


def test_scores_against_brute_force(spark):
    rng = np.random.RandomState(0)
    model = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25
    rows = [(1, "Der Hund Hund bellt"), (2, None), (3, ""), (None, "x"), (1, "Der Hund Hund bellt"), (5, "é " * 70_000 + "longword" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'a' as label")
    got = sorted(((r.doc_id or -1), r.score) for r in quality.score(df, model).collect())
    want = sorted(((i or -1), 1 / (1 + np.exp(-brute_logit(t, model)))) for i, t in rows)
    assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], atol=1e-6)
    assert quality.score(df.limit(0), model).count() == 0


def test_bags_and_steps_against_brute_force():
    """Bags feature by feature; training with plain loops over the same steps."""
    texts = ["good good text", "é ü", "", None, "one <two> three", "spam spam spam spam"]
    for t in texts:
        found, counts = quality.bag(t)
        assert dict(zip(found.tolist(), counts.tolist())) == dict(Counter(brute_features(t)))
    examples = [(i % 2, *quality.bag(t)) for i, t in enumerate(texts)]
    scores, bias = quality.train(examples, steps=18)
    rng = np.random.RandomState(11)
    table = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32).astype(float)
    out, b, step = np.zeros((quality.DIM, 2)), np.zeros(2), 0
    for _ in range(3):
        for i in rng.permutation(len(examples)):
            label, f = examples[i][0], brute_features(texts[i])
            rate = quality.RATE * (1 - step / 18)
            step += 1
            hidden = sum((table[x] for x in f), np.zeros(quality.DIM)) / max(len(f), 1)
            p = np.exp(hidden @ out + b)
            p = p / p.sum() - np.eye(2)[label]
            pull = out @ p
            for d in range(quality.DIM):
                out[d] -= rate * 0.1 * hidden[d] * p
            b -= rate * 0.01 * p
            for x in f:
                table[x] -= rate * pull / len(f)
    assert abs(bias - (b[1] - b[0])) < 1e-5 and np.allclose(scores, table @ (out[:, 1] - out[:, 0]), atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op4_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.95


@pytest.mark.parametrize("value", [None, 1])
def test_no_labels_and_one_class(spark, value):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, value), (None, value)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()]
    assert scores == [0.5, 0.5] if value is None else min(scores) > 0.9

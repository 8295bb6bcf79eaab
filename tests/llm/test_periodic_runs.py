import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from lectern.llm.common import documents
from lectern.llm.periodic_runs import lyndon_lengths, periodic_runs, runs_of, stretches
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lyndon_by_definition(w):
    """The longest Lyndon word at i ends before the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def brute_runs(w, exponent, least):
    """Maximal stretches of every period, without those that have a smaller one."""
    out = []
    for p in range(1, len(w) // exponent + 1):
        x = 0
        while x + p < len(w):
            s = x
            while x + p < len(w) and w[x] == w[x + p]:
                x += 1
            length = x + p - s
            if x > s and length >= max(exponent * p, least):
                part = w[s : s + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((s, length, p))
            x = max(x, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        old = list(w)
        for i in range(a, n):
            w[i] = old[a + (i - a) % p]
    runs = brute_runs(w, 4, 6)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    text = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_words(rng):
    k = rng.randint(1, 5)
    w = [rng.randrange(k) for _ in range(rng.randint(1, 45))]
    if rng.random() < 0.6:
        w = w[: rng.randint(0, 9)] + w[: rng.randint(1, 7)] * rng.randint(2, 8) + w[: rng.randint(0, 6)]
    return w


def test_baier_grouping_gives_the_lyndon_array():
    rng = random.Random(2)
    for _ in range(1500):
        w = random_words(rng)
        assert lyndon_lengths(w, max(w) + 1) == lyndon_by_definition(w)


def test_every_run_of_two_periods_or_more():
    rng = random.Random(3)
    for _ in range(1500):
        w = random_words(rng)
        for exponent, least in ((2, 2), (3, 4), (4, 6)):
            assert [tuple(r) for r in runs_of(np.array(w), exponent, least).tolist()] == brute_runs(w, exponent, least)
    fibonacci = [0]
    last = [1]
    while len(fibonacci) < 600:
        fibonacci, last = fibonacci + last, fibonacci
    assert [tuple(r) for r in runs_of(np.array(fibonacci), 2, 2).tolist()] == brute_runs(fibonacci, 2, 2)


def test_hashes_that_lie_are_found_out():
    """The Thue-Morse sequence, whose halves have equal hashes modulo a power of two whatever the base."""
    w = [0]
    while len(w) < 1 << 13:
        w += [1 - x for x in w]
    for text in (w, w[:3000] * 4 + [7]):
        assert [tuple(r) for r in runs_of(np.array(text), 2, 2).tolist() if r[2] < 40 or r[2] == 3000] == [r for r in brute_runs(text, 2, 2) if r[2] < 40 or r[2] == 3000]


def test_no_run_lies_outside_the_stretches():
    rng = random.Random(4)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(4)]
        ids, parts = np.array([x for t in texts for x in t]), np.repeat(np.arange(4), [len(t) for t in texts])
        cut, at = list(stretches(ids, parts, 6)), 0
        for t in texts:
            for s, length, _ in brute_runs(t, 4, 6):
                assert any(a <= at + s and at + s + length <= b for a, b in cut)
            at += len(t)


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(400)]
    rows += [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 120)))) for i in range(1000, 1200)]
    rows += [(None, "a a a a a a a"), (None, None), (2000, None), (2001, ""), (2002, " \t\n"), (2003, "           "), (2004, "É é É é É é É é"), (5, "a b " * 9), (5, "a b " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as period", "3 as n_words")
    for plant in (True, False):
        assert got(periodic_runs(df, plant=plant).repartition(2)) == sorted((brute_row(i, t, plant) for i, t in rows), key=str)
    assert periodic_runs(df.limit(0)).count() == 0


def test_runs_and_collapsed_text_are_given(spark):
    r = periodic_runs(spark.createDataFrame([(1, "x  a b a b\ta b a b y")], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.collapsed == "x a b y" and r.n_words == 10


def test_a_very_long_text(spark):
    """300,000 words, half of them a period of 1,000, with one word that breaks it."""
    rng = random.Random(6)
    period = [f"p{rng.randrange(300)}" for _ in range(1000)]
    words = [f"w{rng.randrange(30)}" for _ in range(150_000)] + period * 150
    words[250_500] = "break"
    r = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    long = [tuple(x) for x in r.runs if x.period == 1000]
    assert long == [(150_000, 100_500, 1000), (250_501, 49_499, 1000)]


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    assert got(QUERIES["op11_periodic_runs"](spark, SF)) == sorted((brute_row(i, t) for i, t in rows), key=str)

"""Edits and quotations against plain searches."""

import random
import re
import time

import pytest

from lectern.functions.alignment import FIFTHS, MANY, NEAR, aligned, common_places, near, normal_quote, quote_levels, with_edits, with_quote_match
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain_table(a, b):
    """Lengths of what is common to all beginnings."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


@pytest.mark.parametrize("most", [7, 150, 400])
def test_common_places_against_a_plain_table(most):
    rng = random.Random(most)
    for _ in range(1200 // most):
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, most))] for _ in range(2))
        if rng.random() < 0.3:
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 :]
        got = common_places(a, b)
        assert len(got) == plain_table(a, b)[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x < z and y < w for (x, y), (z, w) in zip(got, got[1:]))


def test_50000_words_take_a_second_or_so():
    rng = random.Random(1)
    same = ["word"] * 50_000
    assert len(common_places(same, same[:-7])) == 49_993
    other = [rng.choice("ab") for _ in range(50_000)]
    began = time.process_time()
    assert len(common_places(same[:25_000] + other[:1] + same[25_000:], ["x"] + same[1:] + ["y"])) == 49_999
    assert time.process_time() - began < 2


def test_aligned_against_every_stretch():
    rng = random.Random(2)
    for _ in range(300):
        piece, source = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (14, 70))
        step = len(piece) // 5 + 1
        stretches = [source[max(0, at) : at + FIFTHS * step] for at in range(-FIFTHS * step, len(source), step)]
        assert aligned(piece, source) == max(plain_table(piece, s)[-1][-1] for s in stretches) / len(piece)
    assert aligned("", "abc") == 0 and aligned("abc", "") == 0


def test_near_is_what_alignment_says():
    """Pieces of one word of bits, of more and of none, near at any place, at the end, in sources cut into parts and in short ones."""
    rng, pairs = random.Random(5), []
    for n in [1, 2, 5, 20, 51, 63, 64, 65, 80, 127, 128, 129, 200, MANY, MANY + 1] * 8:
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz аеद"])
        piece = "".join(rng.choice(letters) for _ in range(n))
        source = [rng.choice(letters) for _ in range(rng.choice([0, n // 2, n, 5 * n, 3000]))]
        kept = [c for c in piece if rng.random() > rng.choice([0.15, 0.19, 0.21])]
        at = rng.choice([0, len(source), rng.randint(0, len(source))])
        pairs.append((piece, "".join(source[:at] + kept + source[at:])))
    pairs += [("", "abc"), ("abc", ""), ("a" * 15, "a" * 12), ("a" * 15, "a" * 11)]
    want = [aligned(p, s) >= NEAR for p, s in pairs]
    assert near(pairs).tolist() == want and 20 < sum(want) < len(want) - 20


def test_near_in_parts(monkeypatch):
    monkeypatch.setattr("lectern.functions.alignment.AT_ONCE", 100)
    monkeypatch.setattr("lectern.functions.alignment.BEGINNING", 10)
    test_near_is_what_alignment_says()


def test_a_long_text_takes_no_time_a_character():
    """20 MB for two quotations of 80 characters; character by character they took some 20 seconds."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh  ijklmnopqrstuvw") for _ in range(n))
    rows = [(text(20_000) * 10, [text(80), text(60)]) for _ in range(100)]
    began = time.process_time()
    assert {x for row in quote_levels(rows) for x in row} == {"none"}
    assert time.process_time() - began < 10


def levels(spark, pairs):
    df = spark.createDataFrame(pairs, "quote string, source string").coalesce(1)
    return [r.level for r in with_quote_match(df, "quote", "source").collect()]


def test_quotes(spark):
    assert levels(spark, [("one two three four five", "x ONE two, three four six y"), ("alpha beta", "gamma delta"), ("", "a"), (None, None), ("a", None), ("...", "a")]) == ["near", "none", "none", "none", "none", "none"]
    quotes = [
        ("so... the quick brown fox … ok", "The quick, brown fox!"),
        ("so…", "and so on"),
        ("so…", "nothing"),
        ("the quick brown fox... the lazy dog", "the quick brown fox, far off; a sleepy cat"),
        ("the quikc brown fox jumps", "first words, then the quick brown fox jumps over"),
        ("the quikc brown fox jumps", "the quick " + "zz zzz zz " * 30 + "brown fox jumps"),
    ]
    assert levels(spark, quotes) == ["verbatim", "verbatim", "none", "none", "near", "none"]


def test_a_source_is_sent_once_for_its_quotations(spark):
    plan = QUERIES["quote_check"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_normal_quotes():
    assert normal_quote("  Ａb—C‍ १२ ৩ क़ ড়﻿ ٣") == "ab c 12 3 क ড ٣"


def test_quote_check_gives_what_a_plain_search_does(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def level(quote, source):
        q, s = normal_quote(quote), normal_quote(source)
        if not q or not s:
            return "none"
        if q in s:
            return "verbatim"
        step = len(q) // 5 + 1
        need = 0.8 * len(q)
        # A stretch's letters in common bound what is aligned in it.
        for at in range(-FIFTHS * step, len(s), step):
            part = s[max(0, at) : at + FIFTHS * step]
            if sum(min(q.count(c), part.count(c)) for c in set(q)) >= need and plain_table(q, part)[-1][-1] >= need:
                return "near"
        return "none"

    rows = [r for r in QUERIES["quote_check"](spark, SF).collect() if r.doc_id % 5 == 0]
    assert {r.own for r in rows} >= {"near"}
    for r in rows:
        own = re.sub("(?s)(.{6}).", r"\1", texts[r.doc_id][9:69])
        assert r.own == level(own, texts[r.doc_id]), r.doc_id
        if r.doc_id % 20 == 0:
            assert r.other == level(texts[r.doc_id - 1][:80], texts[r.doc_id]), r.doc_id


def edits_of(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    return [tuple(r.edits) for r in with_edits(df, "a", "b", "c").collect()]


def test_edits_by_hand(spark):
    rows = [
        ("we like red cars", "we love red cars and the cat sat on mats", "then the cat sat on mats"),
        (None, "new words", None),
        ("same", "same", "x"),
        ("a b c d", "a b c d", ""),
        ("Hello, world -", "hello world! -", ""),
        ("one two three", "three", ""),
        ("x", "p q r s t x u v", "p q r s t"),
        ("", "my p q r s t own", "so p q r s t it is"),
        ("p q r s t", "", "p q r s t"),
        ("", "p q r s t u v", "x p q r s t u. y"),
    ]
    want = [
        (["love", "and"], ["like"], ["the cat sat on mats"], 3),
        (["new words"], [], [], 0),
        ([], [], [], 1),
        ([], [], [], 4),
        ([], [], [], 3),
        ([], ["one two"], [], 1),
        (["u v"], [], ["p q r s t"], 1),
        (["my", "own"], [], ["p q r s t"], 0),
        ([], ["p q r s t"], [], 0),
        (["v"], [], ["p q r s t u"], 0),
    ]
    assert edits_of(spark, rows) == want


def test_edits_account_for_every_word(spark):
    rng = random.Random(3)
    rows = [tuple(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(3)) for _ in range(200)]
    for (a, b, c), (written, removed, quoted, kept) in zip(rows, edits_of(spark, rows)):
        count = lambda texts: sum(len(t.split()) for t in texts)
        assert kept == plain_table(a.split(), b.split())[-1][-1]
        assert count(written) + count(quoted) + kept == len(b.split()) and count(removed) + kept == len(a.split())
        # Five words in a row of the passage are never taken for writing; a run may be cut by kept words.
        assert not any(" ".join(t.split()[i : i + 5]) in c for t in written for i in range(len(t.split()) - 4))


def test_one_word_over_and_over(spark):
    (row,) = edits_of(spark, [("no " * 50_000, "no " * 49_990 + "yes", "no no no no no")])
    assert row[0] == ["yes"] and row[3] == 49_990

import hashlib
import random
import struct

import xxhash

from lectern.llm import winnowing as w


def h(data, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed)))[0]


def pair(a, b):
    return h(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))


def brute(text, k=4, win=8):
    words = text.lower().split()
    if not words:
        return []
    if len(words) < k:
        grams = [h(" ".join(words).encode())]
    else:
        x = [h(t.encode()) for t in words]
        grams = [pair(pair(x[i], x[i + 1]), pair(x[i + 2], x[i + 3])) for i in range(len(x) - 3)]
    key = lambda i: ((grams[i] & (2**64 - 1)) >> 9, -i)
    windows = [range(i, i + win) for i in range(len(grams) - win + 1)] or [range(len(grams))]
    picked = []
    for r in windows:
        i = min(r, key=key)
        if i not in picked:
            picked.append(i)
    return [(i, grams[i]) for i in picked]


def table(spark):
    rng = random.Random(9)
    vocab = ["A", "é", "the", "on", "😀x", "zz"]
    rows = [(rng.randrange(10**6), " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 11, 12, 30, 200])))) for _ in range(60)]
    rows += [(10**7, None), (10**7 + 1, " \n "), (10**7 + 3, "word " * 3000), (None, "no id at all in this row")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as piece", "3 as hashes").repartition(3)


def test_against_brute_force(spark):
    rows, df = table(spark)
    got = {r.doc_id: r for r in w.compare_with_edits(df).collect()}
    order = sorted(rows, key=lambda r: -(10**12) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert list(zip(r.positions, r.hashes)) == brute(t)
        assert list(zip(r.edited_positions, r.edited_hashes)) == brute(edited)
        assert list(r.next_hashes) == [x for _, x in brute(nxt)]


def test_match_guarantee(spark):
    rng = random.Random(1)
    for _ in range(20):
        shared = [f"s{rng.randrange(50)}" for _ in range(11)]
        a = " ".join([f"a{rng.randrange(99)}" for _ in range(rng.randint(0, 40))] + shared + ["a"] * 3)
        b = " ".join([f"b{rng.randrange(99)}" for _ in range(rng.randint(0, 40))] + shared + ["b"] * 3)
        assert {x for _, x in brute(a)} & {x for _, x in brute(b)}


def test_repeated_rows_one_row_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.edited_sha256) for r in w.compare_with_edits(df).collect())
    assert len(got) == 3 and got[1] == got[2] and got[1][1] == hashlib.sha256(b"a b c d x y").hexdigest()
    one = w.compare_with_edits(df.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].hashes == one[0].next_hashes
    assert w.compare_with_edits(df.limit(0)).count() == 0

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lectern.llm import token_store


def test_round_trip_against_the_library(spark):
    rng = random.Random(4)
    odd = ["Don't", "it's,\x01x", "\x01", "naïve", "ＦＵＬＬ", "été", "́", "<|endoftext|>", "in<|endoftext|>side", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>.", "a b", "日本語", "🙂!!", "12,345.6", "x y", "İ", "\x1c", "'s", "l'́a"]
    texts = [None, "", " \n", *odd, *[" ".join(rng.choice([*odd, "the", "Word", "wor d"]) for _ in range(rng.randint(0, 60))) for _ in range(120)], "long " * 40_000]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(5000, "same"), (5000, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as frame").repartition(3)
    path = token_store.write(df)
    got = token_store.read(spark, path).collect()
    library = Tokenizer.from_file(token_store.tokenizer_path())
    start = 0
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -(10**9) if i is None else i)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    some = token_store.read(spark, path, doc_ids=[1000, 972]).collect()
    assert {r.doc_id: r.ids for r in some} == {1000: want[1000], 972: want[972]}


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert token_store.read(spark, token_store.write(df)).count() == 0


def test_another_tokenizer_encodes_whole_texts(spark):
    path = token_store.tokenizer_path("byte_bpe_50k.json")
    assert token_store.cuts_at_spaces(token_store.tokenizer_path()) and not token_store.cuts_at_spaces(path)
    texts = ["  Two  words", "a <|endoftext|> b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in token_store.read(spark, token_store.write(df, tokenizer=path)).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}

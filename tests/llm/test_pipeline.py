import re

from tokenizers import Tokenizer

import corpus_pipeline as p
from lectern.llm.common import crc_remainder, documents, stored
from lectern.llm.quality import fit, score
from lectern.llm.token_store import tokenizer_path
from tests.llm.test_near_dedup import brute as brute_dedup
from tests.llm.test_secret_scan import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = documents(spark, SF)
    out = []
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, SF), f"test_{name}")
        out.append(docs)
    rows = [{r.doc_id: r for r in d.collect()} for d in out[:4]]
    everything = {r.doc_id: r for r in documents(spark, SF).collect()}
    assert all(d.columns == documents(spark, SF).columns for d in out[:4])

    model = fit(documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), crc_remainder("doc_id", 5) != 0)
    scores = {r.doc_id: r.score for r in score(documents(spark, SF), model).collect()}
    assert set(rows[0]) == {i for i, s in scores.items() if s >= 0.3} and 0 < len(rows[0]) < len(everything)

    groups = brute_dedup([(i, r.text) for i, r in rows[0].items()], 5, 80)
    assert set(rows[1]) == {i for i, (_, _, kept) in groups.items() if kept} and len(rows[1]) < len(rows[0])

    changed = 0
    for i, r in rows[1].items():
        spans = brute_spans(r.text)
        now = rows[2][i]
        assert now.n_chars == len(now.text) and not brute_spans(now.text)
        changed += bool(spans)
        if not spans and not re.search("eyJ|PRIVATE KEY|gh[pousr]_|xox|://", r.text):
            assert now.text == r.text
    assert changed and set(rows[2]) == set(rows[1]) == set(rows[3])

    library = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for r in out[3].select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        ids.setdefault(r.doc_id, []).append(n and n + 1)
    assert max(map(len, ids.values())) == 2 and all(len(set(n)) == 1 for n in ids.values())
    packed = {}
    for r in out[4].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.piece_length
    assert packed == {i: sum(n) for i, n in ids.items()}


def test_stages_on_odd_rows(spark):
    """Null, empty, repeated rows and ids; further columns named as the stages name their own."""
    more = ["__score", "__id", "__text", "__text_hash", "score", "label", "rank", "name", "component", "blob", "spans", "block", "row", "n_tokens", "epoch"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (3, "a token = abcdefghijklmnop b", "en", "s", 28, 3), (3, "a token = abcdefghijklmnop b", "en", "s", 28, 3), (None, "x", "en", "s", 1, 4), (None, "a b c d e f g", "en", "s", 13, 5), (4, "A b c d e f g", "en", "s", 13, 6), (4, "a b c d e f g", "en", "s", 13, 7)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).selectExpr("*", *[f"'kept' as `{c}`" for c in more])
        for name, stage in p.STAGES[:4]:
            docs = stored(stage(spark, docs, SF), f"odd_{name}")
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars", "extra", *more]
            assert docs.filter(" or ".join(f"`{c}` <> 'kept'" for c in more)).isEmpty()
        if data:
            texts = {r.doc_id: r.text and r.text.lower() for r in docs.collect()}
            assert texts == {1: None, 2: "", 3: "a [secret] b", None: "x", 4: "a b c d e f g"} and docs.filter("doc_id = 3").count() <= 2
        assert p.packing_stage(spark, docs, SF).count() == docs.count()

"""Chunks, their reassembly and quotas in turns, against plain searches over the tables' own texts."""

import re

from lectern.functions import text as fn
from lectern.operators.ordering import round_robin
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain_chunks(text, tokens, overlap):
    """(first sentence, sentences) of each chunk: as many as fit, and the next begins with the most trailing ones that fit the overlap."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    size = [len(s.split()) for s in parts]
    out, a = [], 0
    while a < len(parts):
        b = max([a + 1] + [k for k in range(a + 1, len(parts) + 1) if sum(size[a:k]) <= tokens])
        out.append(parts[a:b])
        if b == len(parts):
            return out
        a = min([k for k in range(a + 1, b) if sum(size[k:b]) <= overlap], default=b)
    return out


def test_chunks_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in sorted(QUERIES["chunk_docs"](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        want = plain_chunks(text, 256, 32)
        assert [r.chunk for r in got.get(i, [])] == [" ".join(c) for c in want]
        assert all((r.total_chunks, r.n_tokens) == (len(want), len(" ".join(c).split())) for r, c in zip(got.get(i, []), want))


def test_documents_of_distinct_words_come_back_whole(spark):
    rows = [(i, " ".join(f"w{i}x{k}" + "." * (k % 7 == 6) for k in range(n))) for i, n in enumerate([0, 1, 6, 127, 128, 129, 500, 3000])]
    chunks = fn.chunked(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", 128, 32).selectExpr("doc", "chunk_index", "chunk as text")
    assert {r.doc: r.text for r in fn.reassembled(chunks, "doc", "chunk_index", "text").collect()} == {i: t for i, t in rows if t}


def test_turns_under_a_budget(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "value", "event_id").collect()
    want = []
    for user in {r.user_id for r in rows}:
        kinds = sorted({r.event_type for r in rows if r.user_id == user})
        lines = {k: sorted((r for r in rows if r.user_id == user and r.event_type == k), key=lambda r: r.event_id) for k in kinds}
        spent, open_, turn, n = 0.0, set(kinds), 0, 0
        while open_:
            for k in kinds:
                if k in open_ and (turn >= len(lines[k]) or spent + lines[k][turn].value > 600):
                    open_.discard(k)
                elif k in open_:
                    spent += lines[k][turn].value
                    want.append((user, k, lines[k][turn].event_id, n))
                    n += 1
            turn += 1
    got = [tuple(r) for r in round_robin(spark.read.parquet(f"{SF}/events.parquet"), "user_id", "event_type", "value", 600, "event_id").collect()]
    assert sorted(got) == sorted(want)

import re

import pytest
from pyspark.sql import functions as F

from lectern.llm.secret_scan import RULES, Rule, listed, redacted, redacted_rows, scan, scan_in_runs

TEXTS = [
    "é😀 password = 'abcdefghijklmnop' tail", "token=short", "token=password:abcdefghijkl", "AKIA" + "A" * 14 + " AKIA" + "B" * 13, "x" + "0123456789abcdef" * 2 + "g",
    "", None, "API_KEY: \"Zz09+/_.=-xx\"", "apikey=" + "a1" * 10, "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3 https://u:p@h", "tOkEn : " + "f" * 40, "nothing", "nothing", "passwd='a' secret='bbbbbbbbbbbb'" * 30,
]


def brute(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "token=" + "z" * 12)], "doc_id long, text string").selectExpr("*", "'b' as blob", "1 as key", "2 as spans")


def test_base_spans_against_python(spark):
    by_path, _, _ = scan(table(spark))
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] for r in by_path.collect()}
    assert got.pop(None) == [(0, 0, 18, "assign")]
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_only_unseen_pairs_are_scanned(spark):
    df = table(spark)
    first = df.filter("doc_id < 6")
    _, ledger, findings = scan(first)
    by_path, ledger, findings = scan(df, ledger=ledger, findings=findings)
    assert ledger.count() == len({t or "" for t in TEXTS}) + 1
    once, _, _ = scan(df)
    assert sorted(by_path.select("doc_id", listed(F.col("spans"))).collect(), key=str) == sorted(once.select("doc_id", listed(F.col("spans"))).collect(), key=str)
    newer = (*RULES[:2], Rule("hex", 2, "[0-9a-f]{40,}", base=True))
    by_path, later, found = scan(df, ledger=ledger, findings=findings, rules=newer)
    assert later.count() == 2 * ledger.count() and {tuple(r.rules) for r in later.subtract(ledger).collect()} == {("hex@2",)}
    assert {r.rule for r in found.collect()} >= {"hex@1", "hex@2"}
    again, last, _ = scan(df, ledger=later, findings=found, rules=newer)
    assert last.count() == later.count() and rows_of(again) == rows_of(by_path) == rows_of(scan(df, rules=newer)[0])
    assert rows_of(scan_in_runs(df, 3)) == rows_of(once)


def rows_of(by_path):
    return sorted(by_path.select("doc_id", listed(F.col("spans"))).collect(), key=str)


def test_a_new_rule_version_replaces_what_the_old_one_found(spark):
    df = spark.createDataFrame([(1, "x " + "a" * 48 + " y " + "b" * 20)], "doc_id long, text string")
    one, two = (Rule("hex", 1, "[0-9a-f]{16,}", base=True),), (Rule("hex", 2, "[0-9a-f]{40,}", base=True),)
    by_path, ledger, findings = scan(df, rules=one)
    assert rows_of(by_path)[0][1] == "hex:2:50,hex:53:73"
    by_path, ledger, findings = scan(df, ledger=ledger, findings=findings, rules=two)
    assert rows_of(by_path)[0][1] == "hex:2:50"
    with pytest.raises(ValueError):
        scan(df, ledger=ledger)


def test_rows_are_redacted_by_their_text(spark):
    """Rows without an id, and two texts under one id; a text of two million characters."""
    long = "é " * 1_000_000
    rows = [(None, "token=" + "z" * 12, 18, 7), (1, "secret: " + "y" * 12, 20, 7), (1, "plain", 5, 7), (2, None, None, 7), (3, long + "token=" + "z" * 12, 2_000_018, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __spans int")
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0, r[3]) for r in redacted_rows(df).collect())
    assert got == [(0, "[secret]", 8, 7), (1, "[secret]", 8, 7), (1, "plain", 5, 7), (2, "", 0, 7), (3, long + "[secret]", 2_000_008, 7)]


def test_redaction_and_empty_table(spark):
    by_path, _, _ = scan(table(spark))
    df = table(spark).select("doc_id", "text").join(by_path, "doc_id").select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t"))
    got = {r.doc_id: r.t for r in df.collect()}
    assert got[0] == "é😀 [secret]' tail" and got[6] is None and got[11] == "nothing" and got[4] == "x[secret]g"
    empty, ledger, _ = scan(table(spark).limit(0))
    assert empty.count() == 0 and ledger.count() == 0


def test_private_keys_go_whole(spark):
    lines = ["MIIEpAIBAAKCAQEA" + f"{i:02d}" * 24 for i in range(5)] + ["Zm9vYmFy+/=="]
    body = "\n".join(lines)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n"
    many = "\n".join(["A" * 64] * 9000)
    texts = {
        f"a\n{begin}\n{body}\n{end}\nb": "a\n[secret]\nb",
        f"a {begin} {' '.join(lines)} {end} b": "a [secret] b",
        f"a\n{begin}\n{head}{body}\n{end}\nb": "a\n[secret]\nb",
        "a " + f"{begin}\n{body}\n{end}".replace("\n", "\\n") + " b": "a [secret] b",
        f"{begin}\n{body}\n{end}\nmid - way\n{begin}\n{body}\n{end}": "[secret]\nmid - way\n[secret]",
        f"a\n{begin}\n{body}\nno end line here": "a\n[secret]no end line here",
        f"a\n{begin}\n{head}{body}": "a\n[secret]",
        f"a {begin} is a header - no key\n{begin}\n{body}\n{end} b": "a [secret] is a header - no key\n[secret] b",
        f"a\n{begin}\n{many}\n{end}\nb": "a\n[secret]\nb",
        f"a\n{begin}\n{many}\n\nplain - words": "a\n[secret]plain - words",
        f"{begin} " + "wo - rd " * 4000: "[secret] " + "wo - rd " * 4000,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_path, _, _ = scan(df)
    got = df.join(by_path, "doc_id").select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == dict(enumerate(texts.values()))
    assert {r.kind: r.version for r in RULES}["private_key"] > 1

import base64
import hashlib

import pytest

from lectern.llm import warc

ROWS = [(5, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (9, None, None), (8, "u", ""), (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "u", "alone"), (4, "u", "<p>é</p>"), (1, "u", "y" * 300_000)]


def brute(rows, least=0):
    first = {}
    for i, _, t in rows:
        t = (t or "").encode()
        if i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        t = (t or "").encode()
        rev = len(t) >= least and t in first and first[t] != i
        out.append((i, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "revisit" if rev else "response", first[t] if rev else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_catalogue_and_records(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as address", "2 as size", "3 as payload")
    path = warc.write(df, least=least)
    assert sorted((tuple(r) for r in warc.catalogue(spark, path).collect()), key=str) == brute(ROWS, least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({t or "" for _, _, t in ROWS})
    records = [(r.page_id, bytes(r.record)) for r in warc.reconstruct(spark, path).collect()]
    assert len(records) == len(ROWS)
    ids = [x.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for _, x in records]
    assert len(set(ids)) == len(ids)
    responses = {x.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for _, x in records if b"WARC-Type: response" in x}
    assert {x.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for _, x in records if b"WARC-Refers-To" in x} <= responses
    assert any(b"WARC-Target-URI: http://b%0D%0AX: y\r\n" in x for _, x in records)
    for i, record in records:
        head, block = record.split(b"\r\n\r\n", 1)
        names = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and int(names[b"Content-Length"]) == len(block) - 4
        if names[b"WARC-Type"] == b"response":
            assert names[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block[:-4]).digest())


def test_a_changed_payload_is_noticed_and_an_empty_table_works(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = warc.write(df)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "concat(payload, cast('!' as binary)) as payload").collect()
    spark.createDataFrame(bad, "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        warc.catalogue(spark, path).collect()
    assert warc.catalogue(spark, warc.write(df.limit(0))).count() == 0

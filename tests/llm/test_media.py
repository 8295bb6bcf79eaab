import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import pytest

from lectern.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
        f.writestr("b.txt", "x" * 90)
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setparams((1, 1, 8000, 0, "NONE", ""))
        f.writeframes(b"\x80" * 11)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b",\0\0\0\0\1\0\1\0\0" + b"\2\2D\1\0" + b";"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n9\n%%EOF\n"
    au = b".snd" + struct.pack(">IIIII", 24, 5, 2, 8000, 1) + b"abcde"
    return {"image/png": png(), "application/zip": z.getvalue(), "audio/wav": w.getvalue(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf, "audio/basic": au, "image/x-portable-graymap": b"P5\n2 2\n255\nabcd"}


def test_types_carving_and_wrong_declarations(spark):
    rng = random.Random(6)
    known = samples()
    rows, want = [], {}
    for i, (kind, value) in enumerate(known.items()):
        rows.append((i, "image/png", value))
        want[i] = (kind, [])
    noise = lambda: bytes(rng.choice(b"abc \x00\x01") for _ in range(rng.randint(1, 80)))
    for i in range(100, 130):
        value, inside = noise(), []
        for kind in rng.sample(sorted(known), 3):
            inside.append((kind, len(value), len(value) + len(known[kind])))
            value += known[kind] + noise()
        rows.append((i, "text/plain", value))
        want[i] = (None, inside)
    rows += [(900, None, None), (901, None, b""), (902, "audio/wav", b"RIFF"), (903, "image/png", known["image/png"][:-3]), (904, "x", b"BM GIF89a %PDF-1. P5\n RIFF" * 50)]
    want |= {i: (None, []) for i in range(900, 905)}
    df = spark.createDataFrame(rows, "id long, declared string, value binary").selectExpr("*", "1 as type", "2 as media")
    got = {r.id: r for r in media.sniffed(df, "id", "value", "declared").collect()}
    assert {i: (r.type, [tuple(e) for e in r.embedded]) for i, r in got.items()} == want
    assert all(r.wrong == (r.type is not None and r.type != r.declared) for r in got.values())
    values = {i: v for i, _, v in rows}
    cut = media.carved(df, "id", "value").collect()
    assert len(cut) == 90 and all(bytes(r.content) == known[r.type] and values[r.id][r.start :].startswith(known[r.type]) for r in cut)
    assert media.sniffed(df.limit(0), "id", "value").count() == 0 and media.carved(df.limit(0), "id", "value").count() == 0


class Pipe(io.BytesIO):
    """Can't be rewound, so that an archive's sizes come after its files."""

    def seekable(self):
        return False

    def seek(self, *_):
        raise OSError

    def tell(self):
        raise OSError


def test_archives_written_to_a_pipe_and_joined_documents():
    z, machine = Pipe(), media.automaton()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
        f.writestr("b.txt", "x" * 90)
    streamed = z.getvalue()
    assert streamed[6] & 8 and media.spans(b"no" + streamed + b"se", machine) == [("application/zip", 2, 2 + len(streamed))]
    pdf = samples()["application/pdf"]
    updated = pdf + b"2 0 obj\nendobj\nstartxref\n40\n%%EOF\n"
    assert media.spans(updated + b"--" + pdf, machine) == [("application/pdf", 0, len(updated)), ("application/pdf", len(updated) + 2, len(updated) + 2 + len(pdf))]
    assert media.spans(b"%PDF-1.4 " + pdf, machine) == [("application/pdf", 0, 9 + len(pdf))]
    hostile = b"%PDF-1.PK\x03\x04PK\x05\x06" * 200_000
    assert media.spans(hostile, machine) == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_media_round_trip(n):
    payload = media.padded(bytes(i % 251 for i in range(n)))
    assert len(payload) % 64 == 0 and payload
    value = media.as_medium(payload)
    kind = media.true_type(media.spans(value, media.automaton()), len(value))
    assert media.samples(value, kind) == payload


def test_texts(spark):
    rows = [(1, "é" * 100), (2, None), (3, ""), (4, "RIFF P5\n1 1\n255\n" * 9), (1, "é" * 100), (None, "x"), (7, "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    got = media.features_of(media.store_texts(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.type and r.media_bytes > r.payload_bytes
    assert by[2].feature == by[3].feature and media.features_of(media.store_texts(df.limit(0))).count() == 0


def test_failing_walks_are_not_walked_again():
    """Values full of beginnings whose walks end nowhere: four times the bytes take about four times as long."""
    machine = media.automaton()
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00\x21\xf9\x04"
    jpeg = b"\xff\xd8\xff\xe0\x00\x02"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s13s", 13, b"IHDR", b"x" * 13) + struct.pack(">I", zlib.crc32(b"IHDR" + b"x" * 13))
    for one in (gif, jpeg, png):
        took = []
        for size in (1 << 17, 1 << 19):
            began = time.process_time()
            assert media.spans(one * (size // len(one)), machine) == []
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.3

"""Media columns: signature sniffing, validation, carving.

An Aho-Corasick automaton finds all magic bytes of a binary value in one pass; for every hit the format's
validator walks its structure and gives the exact length, or rejects it. Valid spans, the earliest first and the
longest of those, are what the value holds: one that starts at 0 and covers everything is the value's true
type, whatever was declared; others are embedded media, which ``carved`` cuts out. Spans inside an accepted span
are not reported.

``store_texts`` keeps payloads as real media: 8-bit samples in a WAV, AU or PGM file, chosen by the payload's
checksum; ``features_of`` reads the stored bytes back through the sniffer.

Defined cases: a null value has no type and no span; an empty one too; a null text is the empty text, stored as
64 zero bytes; repeated rows are handled each; very long values are validated whole; of media that
begin at one place the longest counts, then the first type by name; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import split_batches, stored

UNIT = 64
RATE = 8000

# Magic bytes by media type, in the order that ties are tried.
SIGNATURES = {
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "audio/wav": [b"RIFF"],
    "audio/basic": [b".snd"],
    "image/x-portable-graymap": [b"P5\n"],
    "image/bmp": [b"BM"],
    "application/pdf": [b"%PDF-1."],
    "application/zip": [b"PK\x03\x04"],
}


@lru_cache(maxsize=1)
def _dead_ends(b: bytes) -> dict[str, set[int]]:
    """Of each format, the places in a value from which a walk is known to fail: no place is walked from twice."""
    return {"png": set(), "jpeg": set(), "gif": set(), "gif blocks": set()}


def _png(b: bytes, at: int) -> int | None:
    dead, walked, i = _dead_ends(b)["png"], [], at + 8
    if b[i : i + 8] != b"\0\0\0\rIHDR":
        return None
    while i + 12 <= len(b) and i not in dead:
        walked.append(i)
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or zlib.crc32(memoryview(b)[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            break
        i = end
        if kind == b"IEND":
            return end
    dead.update(walked)
    return None


@lru_cache(maxsize=1)
def _jpeg_marks(b: bytes) -> list[int]:
    return [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", b)]


def _jpeg(b: bytes, at: int) -> int | None:
    """A walk before the first scan and one after it may end differently: the latter's places are the complements."""
    dead, walked, marks, i, scan = _dead_ends(b)["jpeg"], [], _jpeg_marks(b), at + 2, False
    while i + 2 <= len(b) and (~i if scan else i) not in dead:
        walked.append(~i if scan else i)
        kind = b[i + 1]
        if b[i] != 0xFF or kind == 0xD9 and not scan:
            break
        if kind == 0xD9:
            return i + 2
        if i + 4 > len(b):
            break
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xDA:
            scan, found = True, bisect_left(marks, i)
            if found == len(marks):
                break
            i = marks[found]
    dead.update(walked)
    return None


def _gif(b: bytes, at: int) -> int | None:
    dead, dead_blocks = (_dead_ends(b)[k] for k in ("gif", "gif blocks"))
    walked, walked_blocks = [], []

    def blocks(i: int) -> int | None:
        while i < len(b) and i not in dead_blocks:
            walked_blocks.append(i)
            if not b[i]:
                return i + 1
            i += 1 + b[i]
        return None

    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i: int | None = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while i is not None and i < len(b) and i not in dead:
        walked.append(i)
        if b[i] == 0x3B:
            return i + 1
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            local = b[i + 9]
            i = blocks(i + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            break
    dead.update(walked)
    dead_blocks.update(walked_blocks)
    return None


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end, i, kinds = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return None
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, i)
        kinds.append(kind)
        i += 8 + size + (size & 1)
    # Some writers leave out the last chunk's pad byte.
    return end if end <= i <= end + 1 and kinds[:1] == [b"fmt "] and b"data" in kinds else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    offset, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    end = at + offset + size
    return end if 24 <= offset <= 1 << 16 and 1 <= coding <= 27 and rate and 1 <= channels <= 256 and end <= len(b) else None


_PGM = re.compile(rb"P5\n([1-9][0-9]{0,8}) ([1-9][0-9]{0,8})\n([1-9][0-9]{0,4})\n")


def _pgm(b: bytes, at: int) -> int | None:
    m = _PGM.match(b, at)
    end = m and m.end() + int(m[1]) * int(m[2]) * (1 + (int(m[3]) > 255))
    return end if end and end <= len(b) else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, spare, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return at + size if not spare and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size and at + size <= len(b) else None


@lru_cache(maxsize=1)
def _pdf_marks(b: bytes) -> tuple[list[int], list[int]]:
    """Where documents begin in a value, and where end marks end: looked for once."""
    return [m.start() for m in re.finditer(rb"%PDF-1\.", b)], [m.end() for m in re.finditer(rb"startxref\s+[0-9]+\s+%%EOF(?:\r\n|\n|\r)?", b)]


def _pdf(b: bytes, at: int) -> int | None:
    """To the last end mark before another document begins: one that was added to has several."""
    heads, ends = _pdf_marks(b)
    first = bisect_right(ends, at)
    if first == len(ends):
        return None
    after = bisect_left(heads, ends[first])
    last = bisect_right(ends, heads[after]) if after < len(heads) else len(ends)
    return ends[last - 1]


@lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Start and end of every archive in a value, from the end records: they tell where the directory is, and it where the
    first file is. Sizes before the files may be missing, as in archives written to a pipe."""
    found = {}
    for m in re.finditer(rb"PK\x05\x06", b):
        at = m.start()
        if at + 22 > len(b):
            break
        count, size, offset, note = struct.unpack_from("<HIIH", b, at + 10)
        i, end = at - size, at + 22 + note
        start = i - offset
        if start < 0 or end > len(b) or b[start : start + 4] != b"PK\x03\x04":
            continue
        for _ in range(count):
            if b[i : i + 4] != b"PK\x01\x02" or i + 46 > at:
                break
            i += 46 + sum(struct.unpack_from("<HHH", b, i + 28))
        if i == at:
            found.setdefault(start, end)
    return found


def _zip(b: bytes, at: int) -> int | None:
    return _zip_ends(b).get(at)


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "audio/wav": _wav, "audio/basic": _au, "image/x-portable-graymap": _pgm, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magics in SIGNATURES.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def spans(value: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, end) of the valid media in a value, none inside another."""
    hits = sorted((last + 1 - size, kind) for last, (kind, size) in machine.iter(value.decode("latin-1")))
    out: list[tuple[str, int, int]] = []
    free, i = 0, 0
    while i < len(hits):
        start = hits[i][0]
        best: tuple[int, str] | None = None
        while i < len(hits) and hits[i][0] == start:
            kind = hits[i][1]
            if start >= free:
                try:
                    end = VALIDATORS[kind](value, start)
                except struct.error:
                    end = None
                if end and (best is None or end > best[0]):
                    best = (end, kind)
            i += 1
        if best:
            out.append((best[1], start, best[0]))
            free = best[0]
    return out


def true_type(found: list[tuple[str, int, int]], size: int) -> str | None:
    return found[0][0] if len(found) == 1 and found[0][1:] == (0, size) else None


FOUND = "array<struct<type:string,start:long,end:long>>"


def sniffed(df: DataFrame, id_col: str, value_col: str, declared_col: str | None = None) -> DataFrame:
    """id, declared, type (of the whole value), wrong (declared otherwise), embedded (spans that are not the whole)."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in split_batches(batches, "value"):
            types, embedded = [], []
            for value in batch.column(2).to_pylist():
                found = spans(value, machine) if value else []
                types.append(true_type(found, len(value or b"")))
                embedded.append([] if types[-1] else [{"type": t, "start": a, "end": b} for t, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(embedded, kind)], [id_col, "declared", "type", "embedded"])

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col), declared.alias("declared"), F.col(value_col).cast("binary").alias("value"))
    kind_of = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"{id_col} {kind_of}, declared string, type string, embedded {FOUND}")
    return out.withColumn("wrong", F.coalesce(F.col("type").isNotNull() & ~F.col("type").eqNullSafe(F.col("declared")), F.lit(False)))


def carved(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """One row per embedded medium: id, type, start, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in split_batches(batches, "value"):
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = spans(value, machine) if value else []
                if found and not true_type(found, len(value)):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type), pa.array([t for t, _, _ in found]), pa.array([a for _, a, _ in found], pa.int64()), pa.array([value[a:b] for _, a, b in found], pa.binary())], [id_col, "type", "start", "content"])

    rows = df.select(F.col(id_col), F.col(value_col).cast("binary").alias("value"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, type string, start long, content binary")


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def as_medium(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as 8-bit samples of a WAV, AU or PGM file."""
    n, pick = len(payload), zlib.crc32(payload) % 3
    if pick == 0:
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload
    if pick == 1:
        return b".snd" + struct.pack(">IIIII", 24, n, 2, RATE, 1) + payload
    return b"P5\n%d %d\n255\n" % (UNIT, n // UNIT) + payload


def samples(value: bytes, kind: str | None) -> bytes:
    """The 8-bit samples that a stored medium holds."""
    if kind == "audio/wav":
        i = 12
        while value[i : i + 4] != b"data":
            i += 8 + struct.unpack_from("<I", value, i + 4)[0]
        return value[i + 8 : i + 8 + struct.unpack_from("<I", value, i + 4)[0]]
    if kind == "audio/basic":
        return value[struct.unpack_from(">I", value, 4)[0] :]
    m = _PGM.match(value)
    if kind == "image/x-portable-graymap" and m:
        return value[m.end() :]
    raise ValueError(f"no samples in {kind}")


def describe(payload: bytes) -> str:
    """Mean, root mean square around it, share of crossings of the mean, and an 8-bin histogram, in 1/10000."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, levels = len(x), np.arange(256)
    mean = int((counts * levels).sum()) / n
    spread = (float((counts * levels**2).sum()) / n - mean * mean) ** 0.5 if n else 0.0
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    bins = (counts.reshape(8, 32).sum(axis=1) * 10_000 // n).tolist()
    return f"mean={mean:.3f};spread={spread:.3f};crossings={crossings * 10_000 // n};bins={','.join(map(str, bins))}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media): whole texts as stored media; the declared type is left unspecific."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, "text", 16 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([as_medium(padded(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media")


def features_of(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, declared, type, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in split_batches(batches, "media", 16 << 20):
            rows = []
            for value in batch.column(3).to_pylist():
                kind = true_type(spans(value, machine), len(value))
                p = samples(value, kind)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), kind, f"{kind};{describe(p)}"))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "type", "feature"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array([r[i] for r in rows], types[i]) for i in range(7)]], ["doc_id", "n_bytes", "declared", *names])

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, "doc_id long, n_bytes long, declared string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, type string, feature string")

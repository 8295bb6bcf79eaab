"""Timed segments to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


CHUNK = "chunk_index int, total_chunks int, n_tokens int, start double, end double, kind string, ref string, chunk string"


def packed(items: list[tuple[str, float, float, str | None, str | None, bool]], tokens: int = 256, overlap: int = 32) -> list[tuple]:
    """Items (text, start, duration, kind, ref, atomic) to (n, start, end, kind, ref, text), in order.

    Items go in whole until the next would pass the limit; the next chunk begins with the whole trailing items worth at
    most the overlap. An atomic item is never repeated. kind and ref are those of the item, not visual, with most
    tokens, the first of equals; of the first item where all are visual."""
    sized = [(i, len(i[0].split())) for i in items if i[0] and i[0].strip()]
    out, current, fresh = [], [], 0

    def close() -> None:
        texts = [i for i, _ in current]
        spoken = [(n, -k) for k, (i, n) in enumerate(current) if i[3] != "visual"]
        lead = texts[-max(spoken)[1]] if spoken else texts[0]
        out.append((sum(n for _, n in current), min(i[1] for i in texts), max(i[1] + i[2] for i in texts), lead[3], lead[4], " ".join(i[0].strip() for i in texts)))

    for item, n in sized:
        if current and sum(m for _, m in current) + n > tokens:
            close()
            kept, total = [], 0
            for old in reversed(current):
                if old[0][5] or total + old[1] > overlap or total + old[1] + n > tokens:
                    break
                kept.insert(0, old)
                total += old[1]
            current, fresh = kept if len(kept) < len(current) else [], 0
        current.append((item, n))
        fresh += 1
    if current and fresh:
        close()
    return out


def chunk_segments(df: DataFrame, doc: str, segments: str, tokens: int = 256, overlap: int = 32) -> DataFrame:
    """One row (doc, array<struct<text,start,duration,kind,ref,atomic>>) to its chunks: no shuffle."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, parts in zip(pdf[doc], pdf[segments]):
                items = [(s["text"] or "", float(s["start"] or 0), float(s["duration"] or 0), s["kind"], s["ref"], bool(s["atomic"])) for s in (parts if parts is not None else [])]
                chunks = packed(items, tokens, overlap)
                rows += [(key, i, len(chunks), *c) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=[doc, "chunk_index", "total_chunks", "n_tokens", "start", "end", "kind", "ref", "chunk"])

    return df.select(doc, segments).mapInPandas(run, f"{doc} {kinds[doc]}, {CHUNK}")

"""What two texts share, in order: longest common subsequences in rows of bits, for edits and for quotations."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Words in a row that make a quotation.
QUOTED = 5
#: Up to so many rows are kept and walked back through; longer sides are halved.
ROWS_KEPT = 64


# --- the longest common subsequence ---------------------------------------------------------------------------------


def _places(b: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each item the places in b that hold it, as bits."""
    if len(b) <= MANY:
        few: dict[Hashable, int] = {}
        for j, x in enumerate(b):
            few[x] = few.get(x, 0) | 1 << j
        return few
    found: dict[Hashable, list[int]] = {}
    for j, x in enumerate(b):
        found.setdefault(x, []).append(j)
    out = {}
    for x, at in found.items():
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _rows(a: Sequence[Hashable], b: Sequence[Hashable]):
    """After each item of a: bits of b that are 0 where one more item is common to what a has so far and b up to there."""
    every = (1 << len(b)) - 1
    places, row = _places(b), every
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row ^ hit) & every
        yield row


def _lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """Of a and every beginning of b, the length of what is common."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_places(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """(place in a, place in b) of a longest common subsequence.

    Equal ends are taken off; the longer rest is cut where the lengths from both sides add up to most, down to ROWS_KEPT
    rows, which are walked back. Memory grows with the sides, time with their product by 64 bits at once."""
    out, left = [], [(0, len(a), 0, len(b))]
    while left:
        i, m, j, n = left.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i <= ROWS_KEPT:
            rows, end = [(1 << (n - j)) - 1, *_rows(a[i:m], b[j:n])], n - j
            zeros = lambda row, upto: upto - (row & ((1 << upto) - 1)).bit_count()
            for k in range(m - i, 0, -1):
                if end and zeros(rows[k], end) > zeros(rows[k - 1], end):
                    end = (~rows[k] & ((1 << end) - 1)).bit_length() - 1
                    out.append((i + k - 1, j + end))
        else:
            half = (i + m) // 2
            whole = _lengths(a[i:half], b[j:n]) + _lengths(a[half:m][::-1], b[j:n][::-1])[::-1]
            cut = j + int(whole.argmax())
            left += [(i, half, j, cut), (half, m, cut, n)]
    return sorted(out)


# --- edits ------------------------------------------------------------------------------------------------------------

_SIDES = StructType([StructField(c, ArrayType(BooleanType())) for c in ("draft", "final", "foreign")])


def in_a_row(words: Sequence[str], passage: Sequence[str], n: int) -> np.ndarray:
    """Which words lie in n or more in a row that the passage has too."""
    theirs = set(zip(*(passage[i:] for i in range(n))))
    hits = np.array([w in theirs for w in zip(*(words[i:] for i in range(n)))], bool)
    out = np.zeros(len(words), bool)
    for i in range(n if len(hits) else 0):
        out[i : i + len(hits)] |= hits
    return out


def _sides(n: int):
    @F.pandas_udf(_SIDES)
    def run(draft: pd.Series, final: pd.Series, passage: pd.Series) -> pd.DataFrame:
        """Which words of either side are common to both, in order; which of the final ones the passage has n in a row of."""
        rows = []
        for a, b, c in zip(draft, final, passage):
            kept = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for i, j in common_places(a.tolist(), b.tolist()):
                kept[0][i] = kept[1][j] = True
            rows.append((*kept, in_a_row(b.tolist(), c.tolist(), n)))
        return pd.DataFrame(rows, columns=["draft", "final", "foreign"])

    return run


def _words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _keys(words: Column) -> Column:
    """Lower case, without marks at the ends; a word of marks only is itself."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.transform(words, lambda w: F.lower(F.coalesce(F.nullif(bare(w), F.lit("")), w)))


def _runs(words: Column, kept: Column, kind: Column | None = None) -> Column:
    """(kind, text) of the stretches of words that are not kept, as long as their kind is one."""
    places = F.transform(words, lambda _, i: i)
    of = lambda i: F.lit(False) if kind is None else F.get(kind, i)
    apart = lambda i, j: F.coalesce(F.get(kept, j), F.lit(True)) | (of(i) != of(j))
    starts = F.filter(places, lambda i: ~F.get(kept, i) & ((i == 0) | apart(i, i - 1)))
    ends = F.filter(places, lambda i: ~F.get(kept, i) & apart(i, i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(of(s).alias("kind"), F.array_join(F.slice(words, s + 1, e - s + 1), " ").alias("text")))


def with_edits(df, draft: str, final: str, passage: str, name: str = "edits", quoted: int = QUOTED):
    """df with a struct written, removed, quoted (arrays of texts), kept (words): what an edit made of a draft.

    Words compare in lower case without marks at their ends. Stretches of so many words or more that the passage has too are
    quoted, and no writing. Nulls are empty texts."""
    a, b, sides = "__draft", "__final", "__sides"
    df = df.withColumns({a: _words(draft), b: _words(final)})
    # What the lambdas below look into are columns of the step before, not expressions that each step would make anew.
    df = df.withColumn(sides, _sides(quoted)(_keys(F.col(a)), _keys(F.col(b)), _keys(_words(passage))))
    new = _runs(F.col(b), F.col(f"{sides}.final"), F.col(f"{sides}.foreign"))
    old = _runs(F.col(a), F.col(f"{sides}.draft"))
    df = df.withColumns({"__new": new, "__old": old})
    of = lambda runs, kind: F.transform(F.filter(runs, lambda r: r["kind"] == kind), lambda r: r["text"])
    edits = F.struct(
        of("__new", False).alias("written"),
        of("__old", False).alias("removed"),
        of("__new", True).alias("quoted"),
        F.size(F.filter(f"{sides}.final", lambda k: k)).alias("kept"),
    )
    return df.withColumn(name, edits).drop(a, b, sides, "__new", "__old")


# --- quotations -------------------------------------------------------------------------------------------------------

# What a normal quotation lacks (the dots below of two scripts, joiners, the byte order mark), the scripts
# whose digits become ASCII ones, the shortest piece between ellipses that counts alone, and the least share that is near.
DROPPED = "़়‌‍﻿"
ZEROS = (0x0966, 0x09E6)
SHORTEST_PIECE = 6
NEAR = 0.8
_PLAIN = {ord(c): None for c in DROPPED} | {zero + i: str(i) for zero in ZEROS for i in range(10)}
#: A stretch of the source is so many fifths of a piece; a new one starts every fifth.
FIFTHS = 7
#: So many stretches are looked at as one first; longer pieces than MANY are aligned one by one; characters at once, and of a beginning.
JOINED = 4
MANY = 256
AT_ONCE = 1 << 19
BEGINNING = 512
_HAS_PLAIN = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_ELLIPSIS = re.compile(r"\.{3,}|…")


class _Spaced(dict):
    """For translate: letters, marks and numbers as they are, others a space; each is looked up once."""

    def __missing__(self, c: int) -> int:
        out = self[c] = c if unicodedata.category(chr(c))[0] in "LMN" else 32
        return out


_SPACED = _Spaced()


def normal_quote(text: str) -> str:
    """NFKC, lower case, ASCII digits, no joiners or dots below, punctuation to one space."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii() and _HAS_PLAIN.search(t):
        t = t.translate(_PLAIN)
    return " ".join(t.lower().translate(_SPACED).split())


@F.pandas_udf(StringType())
def normalised_quote(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normal_quote(t))


def aligned(piece: str, source: str, enough: float = 1.0) -> float:
    """The largest share of a piece's characters that a stretch of the source has in their order (or the first that is enough).

    Stretches of FIFTHS fifths of the piece start at every fifth. The rows of bits of those that overlap lie side by side in
    one number, a bit apart, so the source is read once."""
    n = len(piece)
    if not n:
        return 0.0
    step, width = n // 5 + 1, n + 1
    lane = (1 << n) - 1
    side_by_side = sum(1 << k * width for k in range(FIFTHS))
    places = {c: bits * side_by_side for c, bits in _places(piece).items()}
    every = row = lane * side_by_side
    best = 0
    for at, c in enumerate(source):
        if at % step == 0:
            k = at // step % FIFTHS
            best = max(best, n - (row >> k * width & lane).bit_count())
            if best >= enough * n:
                break
            row |= lane << k * width
        hit = row & places.get(c, 0)
        row = (row + hit | row ^ hit) & every
    return max(best, *(n - (row >> k * width & lane).bit_count() for k in range(FIFTHS))) / n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _step(piece: str) -> int:
    return len(piece) // 5 + 1


def _windows(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Which pairs, of pieces of as many words of 64 bits, have a stretch that is near.

    Windows of JOINED stretches begin at every JOINED-th fifth, a lane each, and take a character each at a time. What is not
    common to a piece and a window is not common to its stretches; windows that have enough are aligned by stretches."""
    words = -(-max(len(p) for p, _ in pairs) // 64)
    reach = (JOINED - 1 + FIFTHS) * max(_step(p) for p, _ in pairs)
    bits, places = np.zeros((words, 0x110000), np.uint64), [[] for _ in range(words)]
    starts, owner, size = [], [], 0
    for i, (p, s) in enumerate(pairs):
        piece, source, at = _codes(p), _codes(s), np.arange(len(p))
        np.bitwise_or.at(bits, (at >> 6, piece), np.uint64(1) << (at & 63).astype(np.uint64))
        for word, into in zip(bits, places):
            # Beyond the end of a source nothing is common.
            into += [word[source], np.zeros(reach, np.uint64)]
        bits[:, piece] = 0
        starts.append(size + np.arange(0, len(s), JOINED * _step(p)))
        owner.append(np.full(len(starts[-1]), i))
        size += len(s) + reach
    first, lane, places = np.concatenate(starts), np.concatenate(owner), [np.concatenate(x) for x in places]
    rows = [np.full(len(first), -1, np.int64).view(np.uint64) for _ in places]
    for t in range(reach):
        carry = None
        for k, (row, of) in enumerate(zip(rows, places)):
            hit = row & of[first + t]
            total = row + hit
            over = total < row
            if carry is not None:
                total += carry
                over |= total < carry
            rows[k], carry = total | row ^ hit, over.astype(np.uint64)
    common = 64 * words - sum(np.bitwise_count(row).astype(np.int64) for row in rows)
    enough = np.array([NEAR * len(p) for p, _ in pairs]) - 1e-6
    number, found = np.concatenate([np.arange(len(x)) for x in starts]), np.zeros(len(pairs), bool)
    good = np.flatnonzero(common >= enough[lane])
    # Windows in a row are one part of the source.
    for run in np.split(good, np.flatnonzero((np.diff(good) != 1) | (np.diff(lane[good]) != 0)) + 1):
        if len(run) and not found[i := lane[run[0]]]:
            p, s = pairs[i]
            a, b = (int(number[run[x]]) * JOINED * _step(p) for x in (0, -1))
            found[i] = aligned(p, s[a : b + (JOINED - 1 + FIFTHS) * _step(p)], NEAR) >= NEAR
    return found


def _parts(pairs: Sequence[tuple[str, str]], beginnings: bool) -> Iterator[tuple[int, str, str]]:
    """(pair, piece, part of its source), of the beginnings or of what follows: all stretches that begin in a part lie in it."""
    for i, (p, s) in enumerate(pairs):
        by = JOINED * _step(p)
        first, far = -(-BEGINNING // by) * by, -(-AT_ONCE // by) * by
        for at in range(0, min(len(s), first), first) if beginnings else range(first, len(s), far):
            yield i, p, s[at : at + (first if beginnings else far) + FIFTHS * _step(p)]


def near(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Of each (piece, source), whether at least NEAR of the piece's characters are aligned with one stretch of the source.

    What is near a beginning needs no more of its source."""
    out = np.zeros(len(pairs), bool)
    for beginnings in (True, False):
        left = [(p, s if len(p) <= MANY and not done else "") for (p, s), done in zip(pairs, out)]
        waiting: dict[tuple[int, int], list[tuple[int, str, str]]] = {}
        sizes: Counter = Counter()

        def run(rows: list[tuple[int, str, str]]) -> None:
            found = _windows([(p, s) for _, p, s in rows])
            out[[i for (i, _, _), yes in zip(rows, found) if yes]] = True

        for i, p, s in _parts(left, beginnings):
            # Pieces of as many words of 64 bits, with steps of one size, share their lanes.
            key = (len(p) - 1) // 64, _step(p).bit_length()
            waiting.setdefault(key, []).append((i, p, s))
            sizes[key] += len(s)
            if sizes[key] >= AT_ONCE:
                run(waiting.pop(key))
                del sizes[key]
        for rows in waiting.values():
            run(rows)
    for i, (p, s) in enumerate(pairs):
        if len(p) > MANY:
            out[i] = aligned(p, s, NEAR) >= NEAR
    return out


def quote_levels(rows: Iterable[tuple[str, Sequence[str]]]) -> list[list[str]]:
    """Of each (source, quotations), the level of each quotation."""
    out, pairs, of = [], [], []
    for source, quotes in rows:
        held, levels = normal_quote(source), []
        for quote in quotes:
            pieces = [p for p in map(normal_quote, _ELLIPSIS.split(quote)) if len(p) >= SHORTEST_PIECE] or [p for p in [normal_quote(quote)] if p]
            missing = [p for p in pieces if p not in held] if held else []
            levels.append("near" if missing else "verbatim" if pieces and held else "none")
            of += [(len(out), len(levels) - 1)] * len(missing)
            pairs += [(p, held) for p in missing]
        out.append(levels)
    for (i, k), yes in zip(of, near(pairs)):
        if not yes:
            out[i][k] = "none"
    return out


@F.pandas_udf(ArrayType(StringType()))
def _levels(source: pd.Series, quotes: pd.Series) -> pd.Series:
    """Rows of some AT_ONCE characters at a time, so that those of each group of pieces fill their lanes."""
    out, rows, size = [], [], 0
    for s, q in zip(source, quotes):
        rows.append((s, q))
        size += len(s)
        if size >= 8 * AT_ONCE:
            out += quote_levels(rows)
            rows, size = [], 0
    return pd.Series(out + quote_levels(rows), dtype=object)


def with_quote_matches(df, quotes: Mapping[str, str | Column], source: str | Column):
    """df with a column for each quotation: verbatim if every piece between ellipses is contained, near if at least NEAR of every
    piece's characters are aligned with one stretch, else none.

    Pieces of less than SHORTEST_PIECE characters don't count, unless there are no others: then the whole quotation does. Nulls
    are empty texts, with which nothing matches. A source is sent and normalised once for all its quotations."""
    text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    df = df.withColumn("__levels", _levels(text(source), F.array(*map(text, quotes.values()))))
    return df.withColumns({name: F.get("__levels", i) for i, name in enumerate(quotes)}).drop("__levels")


def with_quote_match(df, quote: str | Column, source: str | Column, name: str = "level"):
    """df with the level of one quotation."""
    return with_quote_matches(df, {name: quote}, source)

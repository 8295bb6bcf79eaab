"""Periodic runs of words, by Baier grouping.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` times as long as q, that no neighbouring word
extends keeping q. For each text:

1. Stretches that can hold a run: in a run every three words in a row occur three times or more, so a stretch is cut at
   places whose three words occur less often in it, again and again until nothing is cut. Equal hashes only make counts
   larger, so no run is lost.
2. Baier grouping (phase one of his suffix sorter) of each stretch: suffixes start in groups of equal first words, and
   groups are taken from the highest down. A member's predecessor is the nearest place before it in a lower group; places
   that are the predecessor of equally many members, in one group, leave it together for a new group right above it,
   whose context grows by that many copies of the group at hand. When a group's turn comes, its context is the longest
   Lyndon word that starts at its members: the Lyndon array. Once with the words in order, once in the opposite order.
3. Every run has a root among those Lyndon words (Bannai and others, the runs theorem). Each is extended to both sides by
   the longest common extensions of its two ends, found by bisection over prefix hashes for all roots at once; every run
   is then compared word for word, and extended word for word should a hash have lied.

Texts are read whole. Python takes a few microseconds for each word of a stretch, and each stretch in linear time and
memory but for the sorting of step 1 and the bisection.

Defined cases: null and empty texts have no words and no runs; a very long text is one task's work, its arrays take
about 150 bytes a word; ties for the strongest run go to the smallest start, then period; repeated rows are rows of their
own with equal results; a row without an id is never planted with a period; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import split_batches

EXPONENT, LEAST = 4, 6
#: Texts are worked on together up to so many words, but for a longer single one.
BLOCK_WORDS = 1 << 20
#: Distinct words that are kept apart before numbers start anew with the next block.
MEMO = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def lyndon_lengths(ranks: list[int], letters: int) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there, by Baier grouping of ranks 0 .. letters - 1."""
    n = len(ranks)
    group, out = list(ranks), [0] * n
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    context, below, above = [1] * letters, list(range(-1, letters - 1)), list(range(1, letters + 1))
    # Places whose groups are still to come, as a doubly linked list; the last cell stands before the first place.
    left, right = list(range(-1, n)), list(range(1, n + 1))
    right.append(0)
    left[0] = n
    top = letters - 1
    while top >= 0:
        size, tally = context[top], {}
        last, count = -1, 0
        here = [i for i in members[top] if group[i] == top]
        for i in here:
            out[i] = size
            p, q = left[i], right[i]
            right[p] = q
            left[q] = p
            # All members at or before i are unlinked by now: p is i's predecessor.
            if p == last:
                count += 1
            elif p != n:
                if count:
                    tally.setdefault(count, []).append(last)
                last, count = p, 1
        if count:
            tally.setdefault(count, []).append(last)
        for count in sorted(tally, reverse=True):
            made: dict[int, int] = {}
            for p in tally[count]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    context.append(context[old] + count * size)
                    over = above[old]
                    below.append(old)
                    above.append(over)
                    above[old] = below[over] = new
                members[new].append(p)
                group[p] = new
        members[top] = []
        top = below[top]
    return out


class _Extensions:
    """Longest common extensions of many pairs of places at once, by bisection over prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _BASE)], dtype=np.uint64)
        terms = _mixed(ids.astype(np.uint64) + np.uint64(1)) * self.power[: self.n]
        self.sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from a on are those from b on, for b >= a."""
        return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def _bisected(self, most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = equal(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._bisected(self.n - b, lambda x: self._equal(a, b, x))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._bisected(a.copy(), lambda x: self._equal(a - x, b - x, x))


def _true_ends(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch of this period around the root at a place, word for word."""
    end = at + period
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    while at > 0 and ids[at - 1] == ids[at - 1 + period]:
        at -= 1
    return at, end


def runs_of(ids: np.ndarray, exponent: int = 2, least: int = 2) -> np.ndarray:
    """(start, length, period) of every run of at least so many periods and words, by start, then period."""
    if len(ids) < 2:
        return np.empty((0, 3), np.int64)
    names, ranks = np.unique(ids, return_inverse=True)
    found, reach = [], _Extensions(ranks)
    places = np.arange(len(ranks))
    for order in (ranks, len(names) - 1 - ranks):
        period = np.array(lyndon_lengths(order.tolist(), len(names)), np.int64)
        # A run has roots that end where another period still follows, but for those of fewer than two periods.
        before, after = reach.left(places, np.minimum(places + period, len(ranks))), np.zeros_like(period)
        inner = places + period < len(ranks)
        after[inner] = reach.right(places[inner], (places + period)[inner])
        length = before + period + after
        enough = (length >= exponent * period) & (length >= least)
        found.append(np.c_[places - before, length, period, places][enough])
    found = np.concatenate(found)
    # One root of each run will do.
    _, first = np.unique(found[:, :3], axis=0, return_index=True)
    out = set()
    for s, length, p, at in found[first].tolist():
        e = s + length
        if not (ids[s : e - p] == ids[s + p : e]).all():
            s, e = _true_ends(ids, at, p)
        if e - s >= max(exponent * p, least):
            out.add((s, e - s, p))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def stretches(ids: np.ndarray, parts: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches of words that can hold a run of four periods and so many words; parts numbers the texts."""
    n = len(ids) - 2
    if n < 1:
        return
    h = ids.astype(np.uint64)
    h = _mixed(_mixed(_mixed(h[:n]) * _BASE + h[1 : n + 1]) * _BASE + h[2:])
    at = np.flatnonzero(parts[:n] == parts[2:])
    part = parts[at]
    while len(at):
        key = _mixed(h[at] + part.astype(np.uint64) * _MIX)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[which] >= 3
        kept, old = at[keep], part[keep]
        # A new part starts where a place is missing between two, or another part begins.
        new = np.r_[True, (np.diff(kept) != 1) | (np.diff(old) != 0)][: len(kept)]
        number = np.cumsum(new)
        long = np.bincount(number, minlength=1)[number] >= least - 2 if len(kept) else np.empty(0, bool)
        done = len(kept) == len(at) and long.all()
        at, part = kept[long], number[long]
        if done:
            break
    if len(at):
        first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
        last = np.r_[first[1:], len(at)] - 1
        for a, b in zip(at[first].tolist(), at[last].tolist()):
            yield a, b + 3


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, or for a tenth of the ids those with a period planted from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    copies = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * copies)[: n - a]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """Of the greatest length by period, exactly; then of the smallest start, then period. runs are in that order."""
    best = None
    for s, length, p in runs.tolist():
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    return best


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _block_runs(texts: list[list[bytes]], memo: dict, exponent: int, least: int) -> list[np.ndarray]:
    """The runs of every text of a block."""
    if len(memo) > MEMO:
        memo.clear()
    ids = np.array([memo.setdefault(w, len(memo)) for words in texts for w in words], np.int64)
    sizes = np.array([len(w) for w in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    # The cut into stretches rests on four periods; for fewer, texts are grouped whole.
    cut = stretches(ids, np.repeat(np.arange(len(texts)), sizes), least) if exponent >= 4 and least >= 6 else zip(starts[:-1].tolist(), starts[1:].tolist())
    for a, b in cut:
        k = int(np.searchsorted(starts, a, "right")) - 1
        found = runs_of(ids[a:b], exponent, least)
        if len(found):
            out[k].append(found + [a - starts[k], 0, 0])
    none = np.empty((0, 3), np.int64)
    merged = [np.concatenate(x) if x else none for x in out]
    return [x[np.lexsort((x[:, 2], x[:, 0]))] for x in merged]


def _scan(exponent: int, least: int, plant: bool, with_text: bool):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        for batch in split_batches(batches, "text"):
            ids, texts, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                ids.append(doc_id)
                texts.append(_planted(doc_id, words) if plant else words)
                total += len(words)
                if total >= BLOCK_WORDS:
                    yield ids, texts
                    ids, texts, total = [], [], 0
            if ids:
                yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for ids, texts in blocks(batches):
            rows = []
            for doc_id, words, runs in zip(ids, texts, _block_runs(texts, memo, exponent, least)):
                best = strongest(runs)
                listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs.tolist())
                if len(runs):
                    words_kept = kept_words(len(words), runs)
                    collapsed = b" ".join([w for w, k in zip(words, words_kept.tolist()) if k])
                else:
                    collapsed = b" ".join(words)
                row = [doc_id, len(words), len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None]
                row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                if with_text:
                    row += [[{"start": s, "length": length, "period": p} for s, length, p in runs.tolist()], collapsed.decode("utf-8", "surrogatepass")]
                rows.append(row)
            names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST, plant: bool = False, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_runs, the strongest run (start, length, period, exponent_milli), digests of
    all runs and of the text without repeats, and with_text also both themselves: runs array<struct<start, length, period>>
    and collapsed.

    plant first replaces the words of a tenth of the ids by ones with a period, to try the search on."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods or more")
    schema = SCHEMA + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_text else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan(exponent, least, plant, with_text), schema)

"""MinHash near-duplicate detection with b-bit signatures.

1. Every text becomes its set of word shingles (64-bit hashes); rows with equal sets are one class, named by a
   64-bit hash of the set (two classes of n share a name with probability n * n / 2**65).
2. ``BANDS * ROWS`` minima per class; a band is ``ROWS`` of them, hashed to a bucket. Of each minimum the
   low ``BITS`` bits are kept, packed into longs.
3. Stars: in every bucket the member that shares most with others is compared with the rest, never all pairs.
   Pairs pass a size bound and the collision-corrected similarity estimated from the bit counts of the packed
   signatures (at least ``FINE``), then are confirmed on full sets. Linked classes are contracted; what is not
   linked to its bucket's star gets a new star, as long as a ``PAYS``-th of a round's pairs look linked.
4. Buckets that still hold more than one component, of up to ``SLICE`` members: all that are not of a bucket's largest
   component are compared with all of it, by sizes, by the bit counts of the packed signatures and by those of parities:
   a bit for each of ``PARITY`` slots tells whether an odd number of a set's shingles falls there, so two sets differ in
   at least as many shingles as bits. Only pairs of different components that pass leave a bucket, to be confirmed as
   before. A member is sent once for each bucket.
5. Members of longer buckets that even then hold more than one component. Their shingles are ordered
   by a count sketch, rarest first. Linked sets share one of their first shingles, and how far into each set
   that one may lie follows from both sizes (positional prefix filtering). Of the sets that share a rare shingle, all that
   are not of its largest component are compared with all, by these places and as in 4, in blocks of ``SLICE`` by ``SLICE``.
6. Connected components over the links.

A link of similarity 0.8 shares no bucket with probability (1 - 0.8**6)**48 = 5e-7, is estimated below ``FINE`` with
3e-7 (five standard errors of 288 two-bit minima), and less above 0.8. Two shingles of n share a 64-bit hash, and two
classes a name, with probability n * n / 2**65. There is no cap on the size of a bucket, of a group or of a component. Rows
grow in proportion to those of the buckets: near copies are linked through their star, others that only share a passage, or
a template, leave their bucket only where their estimate does, and members of the longest buckets have rare shingles of
their own. Only a rare shingle of more than ``SLICE`` sets, b, sends each b / ``SLICE`` times.

Defined cases: null and empty texts (or texts without a word) have an empty set and are linked with nothing;
texts with fewer words than a shingle have one shingle, the whole sequence; very long texts are read whole, and
a set is never split over tasks; repeated rows fall in one class; rows that share an id but not a text are
rows of their own; a row without an id takes the smallest id of its component, and is kept where no row of it has
one (or it is linked with nothing); ties between stars go to the larger name; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, split_batches, unused

BANDS, ROWS, BITS = 48, 6, 2
WORDS = BANDS * ROWS * BITS // 64
SIGNATURE = [f"s{i}" for i in range(WORDS)]
FINE = 0.66
#: Another round of stars is made if one of so many of its pairs is estimated to be linked.
PAYS = 2
#: Bytes of full sets that one block of a confirmation holds, but for a longer single set.
BLOCK_BYTES = 4 << 20
#: Counters of the sketch that orders shingles: a broadcast of four bytes each, whatever the input.
SLOT_BITS = 21
#: Sizes of sets in steps of an eighth, for the prefix filter.
STEP = 1.12
#: Signatures on either side of a block.
SLICE = 4096
#: Pairs that are held at once, but for those of a single row.
PAIRS = 1 << 18
#: Bits that bound from below how many shingles two sets differ in.
PARITY = 2048
#: Signatures in one task's group of blocks, about.
BIN_ROWS = 10_000
NO_ID = -(1 << 63)
MEMO = 400_000
_SEED = np.random.RandomState(7)
_A = (_SEED.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEED.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EVEN = 0x5555555555555555
#: What tells the sizes' steps apart in a key.
_STEPS = np.arange(512, dtype=np.uint64) * _STEP


class _WordHashes(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.lower() touches A-Z only, bytes.split() cuts at ASCII space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.array([memo[x] for x in words], np.uint64)
    n = len(words) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h = _mixed(h) * _STEP + w[j : j + n]
    return np.unique(_mixed(h))


def minima(hashes: np.ndarray) -> np.ndarray:
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(len(_A), np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 1024):
        np.minimum(low, (h[at : at + 1024, None] * _A + _B).min(axis=0), out=low)
    return low


def _bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band, for the minima of many rows."""
    m = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), m.shape[:2])
    for j in range(ROWS):
        h = _mixed(h) * _STEP + m[:, :, j]
    return _mixed(h).view(np.int64)


def _packed(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, 32 minima to a long."""
    m = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), WORDS, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(m << shifts, axis=2).view(np.int64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in split_batches(batches, "text"):
            texts = batch.column(2).to_pylist()
            low = np.empty((len(texts), BANDS * ROWS), np.uint32)
            sizes, names = np.empty(len(texts), np.int64), []
            for i, text in enumerate(texts):
                s = shingle_set(text, k, memo)
                sizes[i] = len(s)
                names.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                low[i] = minima(s)
            bands = _bands(low)
            cols = [batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes)]
            cols += [pa.array(np.ascontiguousarray(c)) for c in _packed(low).T]
            cols.append(pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel())))
            yield pa.RecordBatch.from_arrays(cols, ["id", "text_hash", "name", "size", *SIGNATURE, "bands"])

    return run


def _similarity(a: str, b: str):
    """Collision-corrected similarity: equal groups of BITS bits, less what chance gives."""
    differing = 0
    for i in range(WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x
        for j in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, j))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(_EVEN)))
    equal = 1 - differing / F.lit(float(BANDS * ROWS))
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node.

    Each round hooks every node to its smallest neighbour and contracts the edges, which soon leaves few, for the nodes are
    hashes and in no order along a chain (one in rising order would take a round for every four nodes). At the end labels of labels are followed until nothing changes. Each round is stored."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = scratch.store(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not e.isEmpty():
        hook = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
        hook = hook.join(hook.select(F.col("node").alias("component"), F.col("component").alias("above")), "component").select("node", F.col("above").alias("component"))
        hook = scratch.replace(hook, "hooks")
        if labels is None:
            labels = scratch.store(hook, "labels")
        else:
            moved = hook.select(F.col("node").alias("component"), F.col("component").alias("to"))
            labels = scratch.replace(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        x, y = hook.select(F.col("node").alias("a"), F.col("component").alias("x")), hook.select(F.col("node").alias("b"), F.col("component").alias("y"))
        e = e.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = scratch.replace(e, "edges")
    scratch.drop("edges", "hooks")
    while True:
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = scratch.store(labels.join(above, "component").select("node", F.col("component").alias("was"), F.col("above").alias("component")), "steps")
        if step.filter("was <> component").isEmpty():
            scratch.drop("steps")
            return labels
        labels = scratch.replace(step.select("node", "component"), "labels")
        scratch.drop("steps")


def _confirm(percent: int):
    """Links of every block's hub with the others: 100 * intersection >= percent * union, on full sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("block", sort=False):
            part = part.drop_duplicates(["name", "hub"])
            hub, others = part[part["hub"]], part[~part["hub"]]
            if not len(hub) or not len(others):
                continue
            one = np.frombuffer(hub["shingles"].iloc[0], np.uint64)
            sizes = np.array([len(x) // 8 for x in others["shingles"]])
            flat = np.frombuffer(b"".join(others["shingles"]), np.uint64)
            same = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(same, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
            linked = others["name"].to_numpy()[100 * both >= percent * (len(one) + sizes - both)]
            a += [hub["name"].iloc[0]] * len(linked)
            b += linked.tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b), stored, of the linked pairs among (hub, other, other_size): a hub's set goes once to each block of others."""
    load = pairs.groupBy("hub").agg(F.ceil(F.sum("other_size") * 8 / BLOCK_BYTES).alias("blocks"))
    dealt = pairs.join(load, "hub").select("hub", "other", "other_size", F.xxhash64("hub", F.pmod(F.xxhash64("other"), "blocks")).alias("block"))
    dealt = scratch.store(dealt, "dealt_pairs")
    bins = max(1, -(-(dealt.agg(F.sum("other_size")).first()[0] or 0) * 8 // BLOCK_BYTES))
    members = dealt.select(F.col("other").alias("name"), "block", F.lit(False).alias("hub"))
    members = members.unionByName(dealt.select(F.col("hub").alias("name"), "block", F.lit(True).alias("hub")).distinct())
    members = members.withColumn("bin", F.pmod("block", F.lit(bins)))
    links = members.join(sets.select("name", "shingles"), "name").groupBy("bin").applyInPandas(_confirm(percent), "a long, b long")
    links = scratch.store(links, "confirmed")
    scratch.drop("dealt_pairs")
    return links


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in split_batches(batches, "text"):
            sets = [shingle_set(t, k, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["name", "shingles"])

    return run


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot of the sketch occurs in this task's sets."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            np.add.at(total, _slots(np.frombuffer(x, np.uint64)), 1)
    met = np.flatnonzero(total)
    for at in range(0, len(met), 1 << 16):
        some = met[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])


def _size_steps() -> np.ndarray:
    steps = [1]
    while steps[-1] < 1 << 40:
        steps.append(max(steps[-1] + 1, int(steps[-1] * STEP)))
    return np.array(steps)


def _prefixes(shared, percent: int):
    """For each set the first shingles, rarest first, that it can share first with a set of like size.

    A set offers them to larger ones under its own step of sizes (asks false) and asks for those of smaller or equal
    ones under each step in reach. A pair of sizes m and n needs percent * (m + n) / (100 + percent) shingles in common,
    so the first of them lies at most that far before the end of either. Shingles met once in all are left out."""
    steps = _size_steps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for name, component, data in zip(*[c.to_pylist() for c in batch.columns]):
                s = np.frombuffer(data, np.uint64)
                n = counts[_slots(s)]
                order = np.lexsort((s, n))
                s, held, m = s[order], n[order] > 1, len(s)
                least = -(-percent * m // 100)
                own, low = (int(np.searchsorted(steps, x, "right")) - 1 for x in (m, least))
                asks = [(own, m, False)] + [(g, max(int(steps[g]), least), True) for g in range(low, own + 1)]
                for g, other, ask in asks:
                    most = m + percent * (m + other) // -(100 + percent) + 1
                    at = np.flatnonzero(held[: max(most, 0)])
                    if not len(at):
                        continue
                    size = len(at)
                    key = _mixed(s[at] + _STEPS[g]).view(np.int64)
                    cols = [pa.array(key), pa.array(np.full(size, ask)), pa.array(np.full(size, name)), pa.array(np.full(size, component)), pa.array(np.full(size, m)), pa.array(at)]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "asks", "name", "component", "size", "place"])

    return run


PREFIXES = "key long, asks boolean, name long, component long, size long, place long"


def _met(block: np.ndarray, few: np.ndarray, every: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every block the pairs (few, every) of rows, ``PAIRS`` at once."""
    every = every[np.argsort(block[every], kind="stable")]
    low, high = (np.searchsorted(block[every], block[few], side) for side in ("left", "right"))
    before = np.r_[0, np.cumsum(high - low)]
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        row = np.repeat(np.arange(at, to), (high - low)[at:to])
        yield few[row], every[low[row] + np.arange(len(row)) - (before[row] - before[at])]
        at = to


def _estimated_alike(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs are estimated to be at least ``FINE`` alike."""
    least = 1 - (FINE * (1 - 0.5**BITS) + 0.5**BITS)
    differ = bits[x] ^ bits[y]
    for k in range(1, BITS):
        differ |= differ >> np.uint64(k)
    return np.bitwise_count(differ & np.uint64(_EVEN)).sum(axis=1) <= int(np.floor(least * BANDS * ROWS + 1e-9))


PAIR = "hub long, other long, other_size long"


def _pairs_frame(out: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate([np.empty((0, 3), np.int64), *out]), columns=["hub", "other", "other_size"]).drop_duplicates()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = ((np.frombuffer(x, np.uint64) % np.uint64(PARITY)).astype(np.int64) for x in batch.column(1).to_pylist())
        bits = [np.packbits(np.bincount(x, minlength=PARITY).astype(np.uint8) & 1).tobytes() for x in slots]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["name", "parity"])


def _alike_in_buckets(percent: int):
    """Of every bucket the pairs (few, every) of different components that can be linked, by sizes, estimate and parities."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, name, size, component, is_main = (pdf[c].to_numpy() for c in ("bucket", "name", "size", "component", "is_main"))
        bits, out = pdf[SIGNATURE].to_numpy(np.int64).view(np.uint64), []
        parity = np.frombuffer(b"".join(pdf["parity"]), np.uint64).reshape(len(pdf), -1)
        for x, y in _met(bucket, np.flatnonzero(~is_main), np.arange(len(pdf))):
            big, small = np.maximum(size[x], size[y]), np.minimum(size[x], size[y])
            may = (component[x] != component[y]) & (is_main[y] | (name[x] < name[y])) & (100 * small >= percent * big)
            x, y = x[may], y[may]
            ok = _estimated_alike(bits, x, y)
            x, y = x[ok], y[ok]
            ok = (100 + percent) * np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (size[x] + size[y])
            out.append(np.c_[name[x[ok]], name[y[ok]], size[y[ok]]])
        return _pairs_frame(out)

    return run


def _bucket_pairs(placed: DataFrame, tally: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, other, other_size), stored, of members placed (bucket, name, size, component) in the same bucket of those tallied
    (bucket, main, n), of different components, that are estimated to be alike and have parities of linked sets."""
    rows = placed.join(tally.select("bucket", "main"), "bucket").withColumn("is_main", F.col("component") == F.col("main")).drop("main")
    bins = max(1, -(-(tally.agg(F.sum("n")).first()[0] or 0) // BIN_ROWS))
    parities = sets.join(rows.select("name").distinct(), "name", "left_semi").select("name", "shingles").mapInArrow(_parities, "name long, parity binary")
    rows = rows.join(sigs, "name").join(parities, "name").withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(bins)))
    return scratch.store(rows.groupBy("bin").applyInPandas(_alike_in_buckets(percent), PAIR).distinct(), "bucket_pairs")


def _alike(percent: int):
    """Of every block the pairs (few, every) of different components that can be linked, by sizes, places and estimate."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, few = pdf.groupby(["key", "f", "e"], sort=False).ngroup().to_numpy(), pdf["few"].to_numpy()
        asks, name, size, place, component, is_main = (pdf[c].to_numpy() for c in ("asks", "name", "size", "place", "component", "is_main"))
        bits, out = pdf[SIGNATURE].to_numpy(np.int64).view(np.uint64), []
        for x, y in _met(block, np.flatnonzero(few), np.flatnonzero(~few)):
            may = (component[x] != component[y]) & (asks[x] != asks[y]) & (is_main[y] | (name[x] < name[y]))
            x, y = x[may], y[may]
            big, small, left = np.maximum(size[x], size[y]), np.minimum(size[x], size[y]), np.minimum(size[x] - place[x], size[y] - place[y])
            may = (np.where(asks[x], size[x], size[y]) == big) & (100 * small >= percent * big) & ((100 + percent) * left >= percent * (big + small))
            x, y = x[may], y[may]
            ok = _estimated_alike(bits, x, y)
            out.append(np.c_[name[x[ok]], name[y[ok]], size[y[ok]]])
        return _pairs_frame(out)

    return run


def _prefix_pairs(members: DataFrame, sigs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, other, other_size), stored, of members (name, component, shingles) of different components that share a shingle where
    a linked pair must share one, and are estimated to be alike."""
    counted = members.select("shingles").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    counts[counted["slot"].to_numpy()] = np.minimum(counted["n"].to_numpy(), (1 << 31) - 1)
    shared = members.sparkSession.sparkContext.broadcast(counts)
    emitted = scratch.store(members.select("name", "component", "shingles").mapInArrow(_prefixes(shared, percent), PREFIXES), "prefixes")
    tally = emitted.groupBy("key", "component").agg(F.count("*").alias("n"))
    tally = tally.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("components")).filter("components > 1")
    sliced = lambda n: F.ceil(n / SLICE)
    tally = scratch.store(tally.select("key", F.col("most.component").alias("main"), sliced(F.col("n")).alias("es"), sliced(F.col("n") - F.col("most.n")).alias("fs")), "shared_keys")
    # Of a key's components, the one with most rows is never compared with itself.
    live = emitted.join(tally, "key").withColumn("is_main", F.col("component") == F.col("main")).drop("main")
    live = scratch.store(live.join(sigs, "name"), "live_prefixes")
    scratch.drop("prefixes", "shared_keys")
    slice_of = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = live.filter("not is_main").withColumn("few", F.lit(True)).withColumn("f", slice_of("fs")).withColumn("e", all_of("es"))
    every = live.withColumn("few", F.lit(False)).withColumn("e", slice_of("es")).withColumn("f", all_of("fs"))
    bins = max(1, -(-live.count() // BIN_ROWS))
    blocks = few.unionByName(every).drop("es", "fs").withColumn("bin", F.pmod(F.xxhash64("key", "f", "e"), F.lit(bins)))
    pairs = blocks.groupBy("bin").applyInPandas(_alike(percent), PAIR).distinct()
    pairs = scratch.store(pairs, "prefix_pairs")
    scratch.drop("live_prefixes")
    return pairs


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component of each name."""
    if labels is None:
        return members.withColumn("component", F.col("name"))
    return members.join(labels.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows: id, text_hash, name, size; classes: name, component, component_id).

    A row of docs is found again by its id (NO_ID for none) and the xxhash64 of its text; name is null for an empty set.
    component is the same number for linked classes, component_id the smallest id of their rows."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scratch = Scratch(docs.sparkSession, "near_dedup")
    schema = "id long, text_hash long, name long, size long, " + ", ".join(f"{c} long" for c in SIGNATURE) + ", bands array<long>"
    rows = scratch.store(docs.mapInArrow(_signatures(shingle), schema), "signatures")

    same = [F.first(c).alias(c) for c in ("size", "bands", *SIGNATURE)]
    least_id = F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least_id")
    classes = scratch.store(rows.filter("name is not null").groupBy("name").agg(F.min(F.struct("id", "text_hash")).alias("row"), least_id, *same), "classes")
    sigs = classes.select("name", *SIGNATURE)

    banded = classes.select("name", "size", F.explode("bands").alias("bucket"))
    counts = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.store(banded.join(counts, "bucket"), "shared_buckets")
    central = shared.groupBy("name").agg(F.sum("n").alias("central"))
    wanted = central.join(classes.select("name", "row"), "name").select("name", F.col("row.id").alias("id"), F.col("row.text_hash").alias("text_hash"))
    texts = docs.join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("name", "text")
    sets = scratch.store(texts.mapInArrow(_full_sets(shingle), "name long, shingles binary"), "full_sets")
    shared = scratch.replace(shared.select("bucket", "name", "size").join(central, "name"), "shared_buckets")

    def estimated(pairs: DataFrame, name: str) -> DataFrame:
        p = pairs.join(sigs.alias("x"), F.col("hub") == F.col("x.name")).join(sigs.alias("y"), F.col("other") == F.col("y.name"))
        return scratch.store(p.select("hub", "other", "other_size", _similarity("x", "y").alias("estimate")).filter(F.col("estimate") >= FINE), name)

    rest, labels = shared.withColumn("component", F.col("name")), None
    while True:
        star = F.max(F.struct("central", "name", "size", "component")).alias("star")
        stars = rest.groupBy("bucket").agg(star, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket", "star")
        rest = scratch.replace(rest.join(stars, "bucket"), "star_members")
        near = 100 * F.least("size", "star.size") >= percent * F.greatest("size", "star.size")
        pairs = rest.filter((F.col("component") != F.col("star.component")) & near).select(F.col("star.name").alias("hub"), F.col("name").alias("other"), F.col("size").alias("other_size")).distinct()
        pairs = estimated(pairs, "star_pairs")
        likely = pairs.agg(F.count("*"), F.count_if(100 * F.col("estimate") >= percent)).first()
        if labels is not None and likely[1] * PAYS < likely[0] or not likely[0]:
            break
        confirmed(pairs, sets, percent, scratch)
        labels = _merged(labels, scratch, "star_labels")
        scratch.drop("star_pairs")
        rest = _labelled(rest.select("bucket", "name", "size", "central", F.col("star.name").alias("star")), labels)
        stars = labels.select(F.col("node").alias("star"), F.col("component").alias("star_component"))
        rest = rest.join(stars, "star", "left").filter("component <> coalesce(star_component, star)").select("bucket", "name", "size", "central", "component")
    scratch.drop("star_members", "star_pairs")

    def mixed_buckets(placed: DataFrame) -> DataFrame:
        held = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        held = held.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("components"))
        return held.filter("components > 1").select("bucket", F.col("most.component").alias("main"), "n")

    placed = _labelled(shared.select("bucket", "name", "size"), labels)
    tally = scratch.store(mixed_buckets(placed), "mixed_buckets")
    pairs = _bucket_pairs(placed, tally.filter(F.col("n") <= SLICE), sigs, sets, percent, scratch)
    confirmed(pairs, sets, percent, scratch)
    labels = _merged(labels, scratch, "star_labels")
    scratch.drop("bucket_pairs")
    longer = tally.filter(F.col("n") > SLICE).select("bucket")
    if not longer.isEmpty():
        placed = _labelled(shared.join(longer, "bucket", "left_semi").select("bucket", "name"), labels)
        contested = placed.join(mixed_buckets(placed).select("bucket"), "bucket", "left_semi").select("name", "component").distinct()
        members = scratch.store(sets.join(contested, "name").select("name", "component", "shingles"), "contested_sets")
        scratch.drop("full_sets", "shared_buckets")
        pairs = _prefix_pairs(members, sigs, percent, scratch)
        confirmed(pairs, members, percent, scratch)
        labels = _merged(labels, scratch, "star_labels")
    scratch.drop("full_sets", "shared_buckets", "mixed_buckets", "contested_sets", "prefix_pairs")

    named = scratch.store(_labelled(classes.select("name", "least_id"), labels), "named_classes")
    least = scratch.store(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least_ids")
    out = scratch.store(named.join(least, "component").select("name", "component", "component_id"), "components")
    scratch.drop("classes", "star_labels", "named_classes", "least_ids")
    return rows.select("id", "text_hash", "name", "size"), out


def _merged(labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The labels with the confirmed links contracted into them."""
    links = scratch.spark.read.schema("a long, b long").parquet(*scratch.written["confirmed"])
    if labels is not None:
        ends = [labels.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}")) for c in "ab"]
        links = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    found = connected_components(links, scratch)
    if labels is not None:
        moved = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = old.unionByName(found.join(labels.select("node"), "node", "left_anti"))
    out = scratch.replace(found, name)
    scratch.drop("labels", "confirmed")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id), kept: one row per row of docs."""
    rows, classes = clustered(docs, id_col, text_col, shingle, percent)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    component_id = F.when(F.col("name").isNull(), doc_id).otherwise(F.col("component_id"))
    out = rows.join(classes, "name", "left").select(doc_id.alias("doc_id"), F.col("size").alias("n_shingles"), component_id.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with all their columns, one for each component: that with the smallest id (a row without one comes
    last), then with the smallest hash of its text, once. Rows without a word all stay."""
    rows, classes = clustered(docs, id_col, text_col, shingle, percent)
    first = F.min(F.struct(F.col("id") == NO_ID, "id", "text_hash")).alias("first")
    chosen = rows.filter("name is not null").join(classes, "name").groupBy("component").agg(first).select("first.id", "first.text_hash")
    row_id, text_hash = unused(docs, "__id", "__text_hash")
    text = F.col(text_col).cast("string")
    has_words = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    addressed = docs.filter(has_words).withColumn(row_id, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(text_hash, F.xxhash64(text))
    chosen = chosen.toDF(row_id, text_hash)
    once = addressed.join(chosen, [row_id, text_hash]).dropDuplicates([row_id, text_hash]).select(*docs.columns)
    return once.unionByName(docs.filter(~has_words))

"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Every word has a vector, as has each of its character n-grams, all looked up by hash in one table; a document
is the mean of its vectors, and a softmax over two classes scores it. A word equal to the one before it adds a
feature of its own (the bigram of repetition). Training takes at most ``MAX_ROWS`` labelled documents, those
with the smallest hash of their id; tasks turn whole texts to bags of buckets, so the driver holds at most
MAX_ROWS * BUCKETS numbers. For scoring the table and the softmax are folded into one number per bucket
(BUCKETS floats, broadcast): a document's logit is the mean of those, which is one pass over its words.

Defined cases: null and empty texts have no features and get the bias alone; repeated rows are scored each; very long texts are
scored whole, their words in parts; labelled rows of equal rank go by id, then label;
rows without a label, or with a null one, are not used to train; without any label, or with one class only, the
score is 0.5 or that class's; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.llm.common import split_batches

MAX_ROWS = 2400
BUCKETS = 1 << 16
DIM = 8
#: Steps of one document; as many passes over the examples as that takes.
STEPS = 24_000
RATE = 4.0
#: Words whose sums a task keeps, and words of text that it looks up at once.
MEMO, PART = 300_000, 50_000
REPEAT = 0
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, theirs, starts) of the features of words: each word's own, then those of its character 3- and 4-grams
    between boundary marks.

    buckets has three rows, word, 3-gram and 4-gram, with a column for every character of the marked words; theirs
    tells which hold a feature; starts, where each word begins."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _BASE, np.uint64))
    hashes = np.zeros((3, len(codes)), np.uint64)
    hashes[0, starts] = np.add.reduceat(codes * powers[place], starts) if len(words) else 0
    for row, n in ((1, 3), (2, 4)):
        h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
        for i in range(n):
            h = h * _BASE + codes[i : i + len(h)]
        hashes[row, : len(h)] = h
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    buckets = 1 + ((mixed >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets, np.array([place == 0, left >= 3, left >= 4]), starts


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs."""
    words = (text or "").split()
    met = Counter(words)
    buckets, theirs, starts = features(list(met))
    times = np.repeat(list(met.values()), np.diff(np.r_[starts, buckets.shape[1]])) if met else np.zeros(0, np.int64)
    found, at = np.unique(buckets[theirs], return_inverse=True)
    counts = np.bincount(at, np.broadcast_to(times, theirs.shape)[theirs], len(found))
    again = sum(map(str.__eq__, words, words[1:]))
    if again:
        found, counts = np.r_[REPEAT, found], np.r_[again, counts]
    return found.astype(np.int32), counts.astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in split_batches(batches, "text", 4 << 20):
        found = [bag(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["rank", "label", "buckets", "counts"])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 11, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(bucket scores, bias) from (label, buckets, counts): softmax over the mean vector, one document a step."""
    labels = np.array([x[0] for x in examples], np.int64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
    rng = np.random.RandomState(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = -(-steps // len(examples))
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, buckets, counts = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            total = max(counts.sum(), 1.0)
            share = (counts / total)[:, None]
            hidden = (table[buckets] * share).sum(axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            grad = out @ p
            out -= rate * 0.1 * np.outer(hidden, p)
            bias -= rate * 0.01 * p
            table[buckets] -= rate * share * grad
    scores = table @ (out[:, 1] - out[:, 0])
    return scores.astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Train on at most max_rows labelled rows; usable: a condition on the labels' rows."""
    chosen = labels.filter(F.col(label_col).isin(0, 1)) if usable is None else labels.filter(F.col(label_col).isin(0, 1) & usable)
    chosen = chosen.select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("rank")).orderBy("rank", "row_id", "label").limit(max_rows)
    # At most max_rows ids: a bounded broadcast.
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "row_id").select("rank", "label", "text")
    rows = rows.mapInArrow(_bags, "rank long, label int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["rank"], bytes(r["buckets"])))
    return train([(r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows])


#: Bytes of text whose words are held at once, but for those of a longer single text.
SCORED_BYTES = 4 << 20


class _Sums:
    """Of MEMO words, the sum of each one's bucket scores and the number of its features; forgets all when full."""

    def __init__(self, scores: np.ndarray):
        self.scores = scores.astype(np.float64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.total, self.count = np.zeros(MEMO + 1), np.zeros(MEMO + 1)

    def learn(self, words: list[str]) -> None:
        buckets, theirs, starts = features(words)
        n = len(self.at)
        held = np.where(theirs, self.scores[buckets], 0.0).sum(axis=0)
        self.total[n : n + len(words)] = np.add.reduceat(held, starts)
        self.count[n : n + len(words)] = np.add.reduceat(theirs.sum(axis=0), starts)
        self.at.update(zip(words, range(n, n + len(words))))

    def sums(self, parts: list[list[str]]) -> list[tuple[float, float]]:
        """(sum, number) of each part's features, without those of repetition."""
        every = set().union(*parts)
        new = list(every.difference(self.at))
        if len(self.at) + len(new) > MEMO:
            self.clear()
            new = list(every)
        if new:
            self.learn(new)
        places = [np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)) for words in parts]
        return [(self.total[i].sum(), self.count[i].sum()) for i in places]


def logits(texts: list[str | None], memo: _Sums, bias: float) -> np.ndarray:
    split = [(t or "").split() for t in texts]
    parts = [(i, words[at : at + PART]) for i, words in enumerate(split) for at in range(0, len(words), PART)]
    again = np.array([sum(map(str.__eq__, words, words[1:])) for words in split], np.float64)
    total, count = again * memo.scores[REPEAT], again.copy()
    at = 0
    while at < len(parts):
        to, held = at + 1, len(parts[at][1])
        while to < len(parts) and held + len(parts[to][1]) <= PART:
            held += len(parts[to][1])
            to += 1
        for (i, _), (s, n) in zip(parts[at:to], memo.sums([words for _, words in parts[at:to]])):
            total[i] += s
            count[i] += n
        at = to
    return bias + total / np.maximum(count, 1.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: the probability of label 1."""
    spark = docs.sparkSession
    shared, bias = spark.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Sums(shared.value)
        for batch in split_batches(batches, "text", SCORED_BYTES):
            z = logits(batch.column(1).to_pylist(), memo, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "__score") -> DataFrame:
    """The rows of docs with all their columns, and the score of each in one more."""
    shared, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Sums(shared.value)
        for batch in split_batches(batches, text_col, SCORED_BYTES):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            z = logits(texts, memo, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))

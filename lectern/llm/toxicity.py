"""Toxic passages: maximum-scoring segments of token log-odds.

Fitting. Over at most ``MAX_ROWS`` labelled documents, every token's log-odds between toxic and other documents
under a Dirichlet prior (the token's overall share, worth ``PRIOR`` documents, and ``LEAST`` of one), with its
standard error. Copies weigh together as one document. Tokens whose log-odds differ from 0 by ``Z`` standard errors
score their log-odds, if those exceed ``ODDS`` or are below ``-DRIFT``; every other token scores ``-DRIFT``, for
evidence of either kind is unproved. For random text of the other class lambda solves sum(p * exp(lambda * s)) = 1,
and K is counted: the other class's labelled texts are shuffled, and K * n * exp(-lambda * s) is to be as many
segments as score at least s in n of their tokens, s being the median of theirs (``CHANCE`` where they have none).

Scoring. A linear-time scan finds all disjoint maximal-scoring segments. A segment of normalised score
x = lambda * s - ln(K * n) is expected exp(-x) times by chance in n tokens (the extreme-value law); those
expected less than ``EXPECTED`` times are passages. A document's evidence is -ln(E) for the best sum of its
segments' normalised scores (E: how often random text of its length is as toxic); a logistic curve fitted on the
labelled documents turns it into the probability of label 1.

Tokens are the words between white space, lower-cased and stripped of what is no letter at either end.

Defined cases: null and empty texts have no evidence and no passage; repeated rows are scored each; rows without a
label or with a null one are not fitted on; without labels of both kinds nothing is toxic; texts are scanned whole,
however long; of equal segments all are kept, and equal ranks of rows go by id and label; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import split_batches, stored

MAX_ROWS = 20_000
PRIOR, LEAST = 10.0, 0.5
Z, ODDS = 3.3, 2.0
DRIFT = 0.5
CHANCE = 0.1
EXPECTED = 0.05
#: Evidence beyond this, a chance of exp(-40), is as good as certain.
TOP = 40.0
MEMO = 400_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def token(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else _EDGE.sub("", word)


class Model(NamedTuple):
    lexicon: dict[str, float]
    rate: float
    slope: float
    intercept: float
    chance: float = CHANCE


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, length, distinct tokens, and a key that copies and most near copies share: the least hash of a word triple."""
    for batch in split_batches(batches, "text", 8 << 20):
        sizes, keys, bags = [], [], []
        for text in batch.column(1).to_pylist():
            words = (text or "").split()
            sizes.append(len(words))
            keys.append(min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0))
            bags.append(sorted({token(w) for w in set(words)} - {""}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bags, pa.list_(pa.string()))], ["label", "size", "key", "tokens"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """From at most max_rows usable labelled rows, those with the smallest hash of their id."""
    chosen = labels.filter(F.col(label_col).isin(0, 1)) if usable is None else labels.filter(F.col(label_col).isin(0, 1) & usable)
    chosen = chosen.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("rank")).orderBy("rank", "__id", "label").limit(max_rows)
    # At most max_rows ids: a bounded broadcast.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.drop("rank")), "__id").select("label", "text")
    bags = stored(rows.mapInArrow(_bags, "label int, size long, key long, tokens array<string>"), "toxic_bags")
    # Copies count together as one document.
    bags = bags.join(stored(bags.groupBy("label", "key").agg((1 / F.count("*")).alias("weight")), "toxic_weights"), ["label", "key"])
    sums = bags.agg(F.sum(F.col("weight") * (1 - F.col("label"))).alias("n0"), F.sum(F.col("weight") * F.col("label")).alias("n1"), F.sum(F.col("weight") * F.col("size")).alias("size")).first()
    n0, n1 = sums["n0"] or 0.0, sums["n1"] or 0.0
    if not n0 or not n1:
        return Model({}, 1.0, 0.0, -4.0)
    counted = bags.select("label", "weight", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum(F.col("weight") * (1 - F.col("label"))).alias("other"), F.sum(F.col("weight") * F.col("label")).alias("toxic"))
    prior = LEAST + PRIOR * (F.col("other") + F.col("toxic")) / (n0 + n1)
    x, y = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(x / (n1 + 2 * LEAST + PRIOR - x)) - F.log(y / (n0 + 2 * LEAST + PRIOR - y))
    per_word = (n0 + n1) / max(sums["size"], 1.0)
    scored = counted.select("token", F.round(odds, 9).alias("odds"), F.round(odds / F.sqrt(1 / x + 1 / y), 9).alias("z"), (y / n0 * per_word).alias("share"))
    telling = ((F.col("z") > Z) & (F.col("odds") > ODDS)) | ((F.col("z") < -Z) & (F.col("odds") < -DRIFT))
    found = scored.filter(telling).orderBy("token").collect()
    lexicon = {r["token"]: r["odds"] for r in found}
    rate = _lambda(np.array([r["share"] for r in found]), np.array([lexicon[r["token"]] for r in found]))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, rate))
    shuffled = rows.filter("label = 0").select("text").mapInArrow(_by_chance(shared), "tokens long, scores array<double>").collect()
    chance = _chance(sum(r["tokens"] for r in shuffled), sorted(x for r in shuffled for x in r["scores"]), rate)
    seen = rows.mapInArrow(_evidence(shared, chance), "label int, x double").collect()
    return Model(lexicon, rate, *_logistic(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen])), chance)


def _chance(tokens: int, scores: list[float], rate: float) -> float:
    """K, from the segments of so many shuffled tokens, at their median score."""
    if not scores:
        return CHANCE
    at = scores[len(scores) // 2]
    return sum(x >= at for x in scores) * math.exp(min(rate * at, 500.0)) / max(tokens, 1)


def _lambda(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1, bisected."""
    if not len(shares) or float(shares @ scores) >= DRIFT * (1 - shares.sum()):
        return 1.0
    value = lambda x: float(shares @ np.exp(x * scores)) + (1 - shares.sum()) * math.exp(-x * DRIFT) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def segments(at: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text whose tokens score -drift, but scores[i] (of any sign) at at[i].

    Candidates are kept as (start, end, sum before, sum up to); a new one merges back to the nearest candidate
    that starts lower, unless that one already reached as high."""
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for i, s in zip(at, scores):
        before = total - drift * (i - last - 1)
        total, last = before + s, i
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append((*new, j))
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def assess(found: list[tuple[int, int, float]], n: int, rate: float, chance: float = CHANCE) -> tuple[float, list[tuple[int, int, float, float]]]:
    """(evidence, significant passages with their expected number by chance).

    The r best segments together: sum of normalised scores, P ~ exp(-t) * t**(r-1) / (r! (r-1)!)."""
    if not found:
        return 0.0, []
    base = math.log(chance * max(n, 1))
    x = [rate * s - base for _, _, s in found]
    passages = [(a, b, s, math.exp(min(-v, 50.0))) for (a, b, s), v in zip(found, x) if math.exp(min(-v, 50.0)) < EXPECTED]
    best, t = math.inf, 0.0
    for r, v in enumerate(sorted(x, reverse=True), 1):
        t += v
        if v <= 0 and r > 1:
            break
        log = -t if r == 1 else -t + (r - 1) * math.log(max(t, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)
        best = min(best, log + (r - 1) * math.log(2) if r > 1 else log)
    return min(max(-best, 0.0), TOP), passages


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge."""
    w, design = np.zeros(2), np.c_[x, np.ones(len(x))]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        w = w + np.linalg.solve(h, design.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


class _Scores(dict):
    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = s = self.lexicon.get(token(word), 0.0)
        return s


def _scan(text: str | None, memo: _Scores, rate: float, chance: float) -> tuple[float, list[tuple[int, int, float, float]]]:
    words = (text or "").split()
    at = np.flatnonzero([memo[w] for w in words]).tolist()
    return assess(segments(at, [memo[words[i]] for i in at]), len(words), rate, chance)


def _by_chance(shared):
    """Number of tokens and segment scores of each text, its tokens in another order (the same for the same text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Scores(shared.value[0])
        for batch in split_batches(batches, "text"):
            sizes, scores = [], []
            for text in batch.column(0).to_pylist():
                words = (text or "").split()
                mixed = np.random.RandomState(zlib.crc32((text or "").encode("utf-8", "surrogatepass"))).permutation([memo[w] for w in words])
                at = np.flatnonzero(mixed).tolist()
                sizes.append(len(words))
                scores.append([x for *_, x in segments(at, mixed[at].tolist())] if at else [])
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["tokens", "scores"])

    return run


def _evidence(shared, chance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rate = shared.value
        memo = _Scores(lexicon)
        for batch in split_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_scan(t, memo, rate, chance)[0] for t in batch.column(1).to_pylist()], pa.float64())], ["label", "x"])

    return run


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every whole text; a passage is a range of words, the end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = _Scores(m.lexicon)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in split_batches(batches, "text"):
            found = [_scan(t, memo, m.rate, m.chance) for t in batch.column(1).to_pylist()]
            scores = 1 / (1 + np.exp(-np.array([m.slope * x + m.intercept for x, _ in found], np.float64)))
            spans = [[{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in p] for _, p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, score double, passages {PASSAGES}")

"""Which of two languages each word of a text is in: words and letter n-grams weighed, the best path over them, and doubt.

``fit`` learns from texts whose language is known: which words either language uses, and how much more often each n-gram of
letters stands in words of one than of the other. ``tagged`` gives every word a tag: the home language, the other one, ``xx`` for
a word that shows neither, ``ne`` for numbers. The path of least cost over two states, with a cost for each switch,
follows from one number a word: how much better the best path to the other language is than that to home. It is kept within
the cost of a switch, the word's evidence is added, and a word whose sum leaves that range decides for itself and for the
words before it back to the next such word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# Evidence of a word that one language alone uses, of one that both do (at most), of n-grams (factor and most),
# the cost of a switch, and what favours home at the start of a run.
ONLY, BOTH, GRAM_SCALE, GRAM_MOST, SWITCH, START = 3.0, 1.0, 1.5, 2.5, 1.25, 0.25
# Fixed values of doubt: the least share of proved words among them and the unplaced; the share and number of
# unplaced words that make a span one of an unknown language.
PROVED, UNPLACED, UNPLACED_WORDS = 0.3, 0.5, 8
NEUTRAL, UNKNOWN = "ne", "xx"
#: The model holds so many words and n-grams at most, the most frequent ones, which occur LEAST times: a bounded broadcast.
MOST_WORDS, MOST_GRAMS, LEAST = 100_000, 50_000, 3
GRAMS = (1, 2, 3)
#: Bytes of texts whose tags are held at once.
PIECE_BYTES = 1 << 20
TAGS = "array<struct<word:string,norm:string,tag:string>>"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")


class Model(NamedTuple):
    words: dict[str, float]
    #: Words that the other language alone uses.
    proofs: frozenset[str]
    grams: dict[str, float]


def grams_of(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]


def _gram_column(word: str) -> Column:
    padded = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    parts = [F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i, n=n: F.substring(padded, i, F.lit(n))) for n in GRAMS]
    return F.flatten(F.array(*parts))


def fit(docs: DataFrame, text: str, lang: str, home: str, other: str, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS, least: int = LEAST) -> Model:
    """From the texts that are known to be in either language; all words are counted, the model is bounded."""
    known = docs.filter(F.col(lang).isin(home, other)).select((F.col(lang) == other).cast("long").alias("away"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))).alias("word"))
    sums = [F.sum(1 - F.col("away")).alias("h"), F.sum("away").alias("o")]
    counts = known.groupBy("word").agg(*sums).filter(F.col("h") + F.col("o") >= least)
    total = counts.agg(F.sum("h").alias("h"), F.sum("o").alias("o")).first()
    h, o = (float(total[c] or 0) + 1 for c in "ho")
    lean = lambda x: F.log((F.col("o") + x) / o) - F.log((F.col("h") + x) / h)
    rows = counts.select("word", "h", "o", lean(0.5).alias("lean")).orderBy(F.desc(F.col("h") + F.col("o")), "word").limit(most_words).collect()
    words = {r["word"]: ONLY if not r["h"] else -ONLY if not r["o"] else max(-BOTH, min(BOTH, r["lean"])) for r in rows}
    grams = counts.select(F.explode(_gram_column("word")).alias("gram"), "h", "o").groupBy("gram").agg(F.sum("h").alias("h"), F.sum("o").alias("o"))
    rows = grams.select("gram", lean(5.0).alias("lean"), (F.col("h") + F.col("o")).alias("n")).orderBy(F.desc("n"), "gram").limit(most_grams).collect()
    return Model(words, frozenset(r for r, e in words.items() if e == ONLY), {r["gram"]: r["lean"] for r in rows})


def evidence(norm: str, model: Model) -> float:
    """For the other language, against home."""
    known = model.words.get(norm)
    if known is not None:
        return known
    found = [model.grams.get(g, 0.0) for g in grams_of(norm)]
    return max(-GRAM_MOST, min(GRAM_MOST, GRAM_SCALE * sum(found) / len(found)))


def best_path(scores: list[float], switch: float = SWITCH, start: float = START) -> list[bool]:
    """For each word whether the path of least cost has it in the other language; ties stay, and end at home."""
    ahead, at = [], -start
    for s in scores:
        at = max(-switch, min(switch, at)) + s
        ahead.append(at)
    # The end: anything above 0; before it, what leaves the range of a switch, or the word after.
    out, now = [], bool(ahead) and ahead[-1] > 0
    for i in range(len(ahead) - 1, -1, -1):
        if i < len(ahead) - 1:
            now = ahead[i] >= -switch if now else ahead[i] > switch
        out.append(now)
    return out[::-1]


def _latin(word: str) -> bool:
    return all(ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 or c in "'’" for c in word)


def tags_of(text: str, model: Model, home: str, other: str, memo: dict[str, float]) -> list[tuple[str, str, str]]:
    """(word, lower case, tag) of every word and number."""
    words = _TOKEN.findall(text or "")
    norms = [w.lower() for w in words]
    tags = [NEUTRAL if w[0].isdigit() else "" if _latin(w) else other for w in words]
    latin = [i for i, t in enumerate(tags) if not t]
    # Words of another script end a run; numbers don't.
    cuts = [k for k in range(1, len(latin)) if any(tags[j] == other for j in range(latin[k - 1] + 1, latin[k]))]
    for a, b in zip([0, *cuts], [*cuts, len(latin)]):
        run = latin[a:b]
        for i in run:
            if norms[i] not in memo:
                memo[norms[i]] = evidence(norms[i], model)
        for i, away in zip(run, best_path([memo[norms[i]] for i in run])):
            tags[i] = other if away else home
    unplaced = [i for i in latin if norms[i] not in model.words]
    proved = sum(norms[i] in model.proofs for i in latin)
    if unplaced and proved < PROVED * (proved + len(unplaced)):
        foreign = len(latin) >= UNPLACED_WORDS and len(unplaced) >= UNPLACED * len(latin)
        for i in latin if foreign else unplaced:
            if tags[i] == other:
                tags[i] = UNKNOWN
        for i in unplaced if foreign else ():
            tags[i] = UNKNOWN
    return list(zip(words, norms, tags))


def _pieces(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about PIECE_BYTES, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > PIECE_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if len(sizes) > at:
            yield batch.slice(at)


def tagged_batches(batches: Iterator[pa.RecordBatch], place: int, model: Model, home: str, other: str, name: str, memo_words: int) -> Iterator[pa.RecordBatch]:
    """The rows with the tags of the texts in the column at a place."""
    memo: dict[str, float] = {}
    for batch in _pieces(batches, place):
        ends, flat = [0], ([], [], [])
        for t in batch.column(place).to_pylist():
            if len(memo) > memo_words:
                memo.clear()
            for column, values in zip(flat, zip(*tags_of(t, model, home, other, memo))):
                column.extend(values)
            ends.append(len(flat[0]))
        words = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in flat], ["word", "norm", "tag"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)], [*batch.schema.names, name])


def tagged(df: DataFrame, model: Model, text: str, home: str, other: str, name: str = "tags", memo_words: int = 200_000) -> DataFrame:
    """df with an array (word, norm, tag) of every whole text, by rows: nothing is shuffled. A null text has none.

    A task holds the tags of PIECE_BYTES of text at once, or those of one longer text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)
    run = lambda batches: tagged_batches(batches, place, shared.value, home, other, name, memo_words)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DataType.fromDDL(TAGS))]))

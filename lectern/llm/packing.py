"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut; pieces are dealt by hash into independent blocks of about
``BLOCK`` pieces, so that no task holds more, and each block is packed in decreasing order of length: a
piece goes to the open sequence it fills best. Where none has room, every permitted length that holds the piece
is filled, on trial, with the largest pieces left that still fit; the length that then costs least for each token
(shrunk to what it holds) is opened. At the end every sequence shrinks to the shortest permitted length that
holds its contents.

The length of a document is given as a column: ``best_fit_texts`` counts its ids and end id by the tokenizer of
op1_token_store. Without one, ``best_fit`` counts words at white space.

Defined cases: texts without ids or words, also null ones, have length 0 and one row without a sequence; repeated rows are packed
each, and spread over blocks like rows without an id; how the rows are laid out changes nothing; very long texts become many pieces, which are spread too; equal
pieces go in the order of their ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.llm.mixing import word_count
from lectern.llm.token_store import token_counts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BLOCK = 2048
#: Cost of a sequence of c tokens: c, as much again at QUADRATIC tokens (attention), and FIXED for its start.
FIXED, QUADRATIC = 64, 16384


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / QUADRATIC


def _trial(ascending: list[int], left: int, room: int) -> int:
    """How much of the room the largest of the first ``left`` pieces fill that still fit, one after another."""
    filled = 0
    while left and room >= ascending[0]:
        left = bisect_right(ascending, room, 0, left) - 1
        filled += ascending[left]
        room -= ascending[left]
    return filled


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], dict[int, int]]:
    """(sequence, offset) of each item, none longer than the largest capacity, and the final length of each sequence.

    Ties: equal items in their given order; of sequences with equal room the one opened first; of lengths that cost
    the same for a token the shorter one."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ascending = sorted(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for done, i in enumerate(order):
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, s = room.pop(at)
        else:
            best = (inf, 0)
            for c in sizes[bisect_left(sizes, n) :]:
                held = n + _trial(ascending, len(lengths) - done - 1, c - n)
                best = min(best, (cost(sizes[bisect_left(sizes, held)]) / held, c))
            free, s = best[1], len(used)
            used.append(0)
        sequence[i], offset[i] = s, used[s]
        used[s] += n
        if free > n:
            insort(room, (free - n, s))
    return sequence, offset, {s: sizes[bisect_left(sizes, u)] for s, u in enumerate(used)}


def _pack_block(capacities: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        sequence, offset, final = pack(pdf["piece_length"].tolist(), capacities)
        block = f"{pdf['block'].iloc[0]}-"
        return pdf.assign(sequence_id=[block + str(s) for s in sequence], sequence_length=[final[s] for s in sequence], offset=offset).drop(columns="block")

    return run


def best_fit(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, piece_start, piece_length, sequence_id, sequence_length, offset."""
    most = max(capacities)
    n = F.coalesce(word_count("text") if length is None else length, F.lit(0)).cast("long")
    items = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")), "pack_items")
    count = F.greatest(F.ceil(F.col("n") / most), F.lit(1).cast("long"))
    blocks = max(1, -(-(items.agg(F.sum(count)).first()[0] or 0) // block))
    # Equal rows (also those without an id) are numbered, so that they spread, and any layout of the rows gives one result: a
    # row for each (doc_id, n) carries their number through the shuffle, and they are told apart after it.
    items = items.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    numbers = lambda first, last: F.explode(F.sequence(F.greatest(first, F.lit(1)).cast("long"), last))
    few = items.filter(F.col("copies") <= BLOCK).select("doc_id", "n", numbers(F.lit(1), F.col("copies")).alias("row"))
    # Those of many copies are counted out by several tasks.
    many = items.filter(F.col("copies") > BLOCK).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / BLOCK))).alias("k")).repartition("doc_id", "n", "k")
    last = F.least(F.col("k") * BLOCK + BLOCK - 1, F.col("copies"))
    items = few.unionByName(many.select("doc_id", "n", numbers(F.col("k") * BLOCK, last).alias("row")))
    pieces = items.select("row", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.select("row", "doc_id", "piece", (F.col("piece") * most).alias("piece_start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("piece_length"))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(blocks))).drop("row")
    schema = "doc_id long, piece long, piece_start long, piece_length long, sequence_id string, sequence_length long, offset long"
    packed = pieces.filter("piece_length > 0").groupBy("block").applyInPandas(_pack_block(capacities), schema)
    empty = pieces.filter("piece_length = 0").select("doc_id", "piece", "piece_start", "piece_length", F.lit(None).cast("string").alias("sequence_id"), F.lit(None).cast("long").alias("sequence_length"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(empty)


def best_fit_texts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """best_fit with lengths in token ids."""
    return best_fit(token_counts(docs, [id_col]), id_col, F.col("n_tokens"), **options)

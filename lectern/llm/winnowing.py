"""Document fingerprints by winnowing. DataFrame functions only.

The unit is the lower-cased word. Every K words in a row are hashed, rolling by doubling (pairs of words, then
pairs of pairs); of every W hashes in a row the smallest is selected, the rightmost of equal ones, again by
doubling. Any two texts that share K + W - 1 words in a row therefore share a selected hash, and positions (of
the gram's first word) tell where.

A hash and its place within the window are one number, hash * 256 + 255 - place, so that the smaller number is the
smaller hash and, between equal ones, the further right; moving a window by s lowers it by s.

Defined cases: a null text is the empty text, with an empty fingerprint; fewer than K words are one gram, fewer
than W grams one window; two empty fingerprints are alike (1.0); repeated rows get equal results; very long
texts are fingerprinted whole, as arrays of one row; of equal minima of a window the rightmost place is kept; an empty table
gives an empty result; other columns are carried by ``fingerprints`` under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import stored, unused

#: Powers of two.
K, W = 4, 8
SPACE = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
#: Characters of text, and ids, that one task gets where all are dealt out: their number follows the input.
PART_CHARS, PART_IDS = 8 << 20, 1 << 20


def _shifted(a: str, by: int, f) -> Column:
    """f over every element and the one by places after it."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), f)


def fingerprints(df: DataFrame, text: str = "text", hashes: str = "hashes", positions: str = "positions", k: int = K, w: int = W) -> DataFrame:
    """df with the selected hashes and their positions, in order; both arrays are as long."""
    kept = df.columns
    words_c, short_c, grams_c, low_c, few_c = unused(df, "__words", "__short", "__grams", "__low", "__few")
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    out = df.withColumn(words_c, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+")))
    short = F.when(F.size(words_c) > 0, F.array(F.xxhash64(F.array_join(words_c, " ")))).otherwise(F.array().cast("array<bigint>"))
    out = out.select(*kept, F.when(F.size(words_c) < k, short).alias(short_c), F.transform(words_c, lambda x: F.xxhash64(x)).alias(grams_c))
    span = 1
    while span < k:
        out = out.withColumn(grams_c, _shifted(grams_c, span, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    out = out.withColumn(grams_c, F.coalesce(short_c, grams_c)).drop(short_c)
    out = out.withColumn(low_c, F.transform(grams_c, lambda g: F.shiftleft(F.shiftrightunsigned(g, 9), 8).bitwiseOR(F.lit(255))))
    # Fewer grams than a window: one window, its places counted from the first gram.
    few = F.when(F.size(low_c) > 0, F.array(F.array_min(F.transform(low_c, lambda x, i: x - i)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(few_c, F.when(F.size(low_c) < w, few))
    span = 1
    while span < w:
        out = out.withColumn(low_c, _shifted(low_c, span, _lower(span)))
        span *= 2
    out = out.withColumn(low_c, F.coalesce(few_c, low_c))
    out = out.withColumn(positions, F.array_distinct(F.transform(low_c, lambda x, i: i + 255 - x.bitwiseAND(F.lit(255)).cast("int"))))
    out = out.withColumn(hashes, F.transform(positions, lambda p: F.get(grams_c, p)))
    return out.select(*[c for c in kept if c not in (hashes, positions)], hashes, positions)


def _lower(span: int):
    return lambda a, b: F.least(a, b - span)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two lists of hashes."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def digest(hashes: str, positions: str) -> Column:
    """A fingerprint as a short string."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(hashes, positions)), 16, "0"), F.lpad(F.hex(F.xxhash64(positions, hashes)), 16, "0")))


def successors(ids: DataFrame, parts: int) -> DataFrame:
    """(id, next): of distinct ids, the next smaller one; after the smallest comes the largest.

    Ids are sorted across partitions; neighbours differ by one in the number each row gets, but for the first of a partition."""
    order = stored(ids.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id()), "id_order")
    ends = order.groupBy(F.shiftright("row", 33).alias("part")).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    # One row per partition.
    every = Window.orderBy("part")
    ends = ends.select(F.col("first").alias("row"), F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    linked = order.join(ends, "row", "left").withColumn("before", F.coalesce("before", F.col("row") - 1))
    return linked.join(order.select(F.col("row").alias("before"), F.col("id").alias("next")), "before").drop("before", "row")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's.

    Edited: the last third (rounded down) of the code points replaced by as many first ones of the next document,
    in descending order of ids; of rows that share an id the one with the largest hash of its text stands for it
    as a next document. A row without an id comes after all others.

    Texts move twice: all by id, and the replacing third to the document that asked for it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    heads = rows.groupBy("id").agg(F.max(F.xxhash64("text")).alias("key"), F.max(F.length("text")).alias("n"), F.sum(F.length("text")).alias("chars"))
    heads = stored(heads, "winnow_heads")
    held = heads.agg(F.sum("chars").alias("chars"), F.count("*").alias("ids")).first()
    parts = max(1, -(-(held["chars"] or 0) // PART_CHARS))
    asks = successors(heads.select("id", "n"), max(1, -(-held["ids"] // PART_IDS))).select(F.col("next").alias("id"), F.col("id").alias("asker"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    asks = stored(asks.join(heads.select("id", "key"), "id"), "winnow_asks")

    dealt = rows.repartition(parts, "id")
    sent = dealt.join(asks, "id").filter(F.xxhash64("text").bitwiseXOR(F.col("key")) == 0).select("asker", "need", "text")
    sent = fingerprints(sent).select(F.col("asker").alias("id"), F.left("text", "need").alias("piece"), F.col("hashes").alias("next_hashes"))
    # In as many partitions as the texts, which then are not dealt again for the join.
    sent = sent.repartition(parts, "id").dropDuplicates(["id"])
    out = dealt.join(sent, "id")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    out = out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "next_hashes", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - cut), F.left("piece", cut)).alias("edited"))
    out = fingerprints(out).drop("text")
    out = fingerprints(out, "edited", "edited_hashes", "edited_positions")
    return out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")

"""Temperature mixing of sources to target weights. DataFrame functions only.

A source with share p of all tokens gets the weight p**a / sum(p**a). The exponent a is bisected: the largest
whose entropy reaches ``target_entropy``, or the smallest under which no source is repeated more than
``max_epochs`` times. Weights times the budget are tokens per source, spent on whole epochs and a part of one.
An epoch is a permutation of the source's blocks, each a permutation of its documents; a source of n documents
has about sqrt(n) blocks of sqrt(n) documents, so no window holds more rows than that, however large the source.

Tokens are counted by ``token_estimate``, from the bytes of a text and without leaving the JVM, or given as a column.

Without a budget it is the smallest that gives every source one whole epoch: no document is left out.

Defined cases: a null source is the source named ''; a null or empty text has no tokens; a source without
tokens gets weight 0 and one epoch; repeated rows are rows of their own; very long
texts are whole items of their block; equal draws go by id, then by tokens; an empty table gives an empty
result; other columns are carried by ``mixed_rows`` only.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import stored, unused

SEED = 17
#: Bisections that one job does: it tries all points that so many halvings can reach.
LEVELS = 4
HALVINGS = 32
PLACES = 6
#: Bytes that an id of the 49k tokenizer stands for; by document it differs by 8 % (words an id: by 20 %).
BYTES_PER_TOKEN = 2.75
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def token_estimate(text: str | Column) -> Column:
    """About how many ids a text has: its UTF-8 bytes by BYTES_PER_TOKEN, without white space at its ends."""
    bare = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACE))
    return F.ceil(F.octet_length(bare) / F.lit(BYTES_PER_TOKEN)).cast("long")


def _draw(*parts: Column) -> Column:
    """A fixed pseudo-random number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _met(shares: DataFrame, exponents: list[float], target_entropy: float | None, max_epochs: float | None, budget: float | None) -> dict[float, bool]:
    """Whether each exponent is too large, for the entropy, or large enough, for the repetition."""
    tried = shares.select("p", "tokens", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    w = F.pow("p", "a")
    sums = tried.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("l"), F.max(w / F.col("tokens")).alias("hi"), F.min(w / F.col("tokens")).alias("lo"))
    if target_entropy is not None:
        ok = F.log("z") - F.col("a") * F.col("l") / F.col("z") < target_entropy
    elif budget is not None:
        ok = budget * F.col("hi") / F.col("z") <= max_epochs
    else:
        ok = F.col("hi") / F.col("lo") <= max_epochs
    return {r["a"]: r["ok"] for r in sums.select("a", ok.alias("ok")).collect()}


def exponent(sources: DataFrame, target_entropy: float | None = None, max_epochs: float | None = 2.0, budget: float | None = None) -> float:
    """Bisected between 0 (all sources alike) and 1 (as they are); of PLACES decimals, rounded to the side that keeps the limit."""
    shares = sources.filter("tokens > 0").withColumn("p", F.col("tokens") / F.col("total"))
    low, high, n = 0.0, 1.0, 1 << LEVELS
    ends = _met(shares, [low, high], target_entropy, max_epochs, budget)
    if not ends or ends[low] or not ends[high]:
        return low if not ends or ends[low] else high
    for _ in range(HALVINGS // LEVELS):
        points = [low + (high - low) * i / n for i in range(n + 1)]
        met = _met(shares, points[1:-1], target_entropy, max_epochs, budget) | {low: False, high: True}
        i = next(i for i, x in enumerate(points) if met[x])
        low, high = points[i - 1], points[i]
    # Entropy falls and repetition falls with the exponent.
    return floor(low * 10**PLACES) / 10**PLACES if target_entropy is not None else ceil(high * 10**PLACES) / 10**PLACES


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, target_entropy: float | None = None, max_epochs: float | None = 2.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per document and epoch: doc_id, source, n_tokens, epoch, block, block_rank, slot, weight.

    Within a source, (epoch, block_rank, slot) is the order to read the documents in."""
    n_tokens = token_estimate("text") if tokens is None else tokens
    items = stored(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n_tokens")), "mix_items")
    sources = items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    sources = stored(sources.withColumn("total", F.lit(float(total))), "mix_sources")
    a = exponent(sources, target_entropy, max_epochs, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(a))).otherwise(0.0)
    sums = sources.select(power.alias("w"), "tokens").agg(F.sum("w").alias("z"), F.min(F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))).alias("lo")).first()
    z, lo = sums["z"] or 1.0, sums["lo"] or 1.0
    rate = power / F.col("tokens") / lo if budget is None else F.lit(budget) * power / F.lit(z) / F.col("tokens")
    sources = sources.withColumn("weight", power / z).withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(1.0))
    sources = sources.withColumn("whole", F.floor("rate")).withColumn("part", F.floor((F.col("rate") - F.col("whole")) * F.col("tokens")))
    sources = sources.withColumn("blocks", F.ceil(F.sqrt("n"))).select("source", "weight", "whole", "part", "blocks")

    placed = items.join(sources, "source").withColumn("block", F.pmod(_draw(F.lit(seed), F.col("doc_id")), "blocks"))
    drawn = _draw(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block"))
    order = Window.partitionBy("source", "epoch").orderBy(drawn, "block")
    blocks = placed.groupBy("source", "block", "whole", "part").agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "whole")))
    blocks = blocks.withColumn("block_rank", F.row_number().over(order)).withColumn("before", F.sum("size").over(order) - F.col("size"))
    blocks = blocks.filter("epoch < whole or before < part").select("source", "epoch", "block", "block_rank", "before")
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "whole")))
    inner = Window.partitionBy("source", "epoch", "block").orderBy(_draw(F.lit(seed), F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens")
    copies = copies.join(blocks, ["source", "epoch", "block"]).withColumn("slot", F.row_number().over(inner)).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return copies.filter("epoch < whole or upto <= part").select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank", "slot", "weight")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", planned: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs, each as often as the plan has it: a plan of docs, or of ``planned``, the same rows with other columns."""
    key, rows, times, copy = unused(docs, "__id", "__rows", "__times", "__copy")
    counts = plan(docs if planned is None else planned, id_col, **options).groupBy("doc_id").agg(F.count("*").alias(times))
    same = docs.groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias(rows))
    # Rows that share an id share its copies: as many for each of them.
    counts = counts.join(same, F.col("doc_id").eqNullSafe(F.col(key))).select(key, F.floor(F.col(times) / F.col(rows)).alias(times))
    counts = stored(counts, "mix_copies")
    out = docs.join(counts, F.col(id_col).eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1).cast("long"))))).select(*docs.columns)

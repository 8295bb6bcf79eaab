"""Whether the details of a claim are said in a source.

A figure is said where the source says its value, in figures or in words; an identifier where its letters and digits
follow each other in the source's; a quoted phrase where its words do.

Defined cases: a null claim has no details, a null source says nothing; repeated rows get equal results; rows that share an id
count as one source; an empty table of sources supports nothing; columns of any name are carried or not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.details import compact, details, phrase_words, spoken_numbers


def unsupported(df: DataFrame, claim: str, source: str, name: str = "unsupported") -> DataFrame:
    """df with the claim's details (kind, key, strong) that the source in the same row does not say."""
    text = F.coalesce(F.col(source), F.lit(""))
    # One array of what the source says, computed once a row.
    said = F.struct(spoken_numbers(text).alias("numbers"), compact(text).alias("letters"), F.concat(F.lit(" "), phrase_words(text), F.lit(" ")).alias("words"))

    def is_said(d: Column, s: Column) -> Column:
        in_words = F.contains(s["words"], F.concat(F.lit(" "), d["key"], F.lit(" ")))
        return F.when(d["kind"] == "number", F.array_contains(s["numbers"], d["key"])).when(d["kind"] == "identifier", F.contains(s["letters"], d["key"])).otherwise(in_words)

    left = F.get(F.transform(F.array(said), lambda s: F.filter(details(F.col(claim)), lambda d: ~is_said(d, s))), 0)
    return df.withColumn(name, left)


#: Phrases asked for are told apart by so many numbers, a bounded broadcast, before the sources' runs of words are shuffled.
SLOTS = 1 << 18


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def _runs(words: str, n: str) -> Column:
    """Every n words in a row, of at least n, once."""
    starts = F.sequence(F.lit(1), F.size(words) - (F.col(n) - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.col(n)), " ")))


def sources_of(claims: DataFrame, sources: DataFrame, claim_id: str, claim: str, source_id: str, source: str) -> DataFrame:
    """(claim_id, kind, key, strong, n_sources, first_source): each claim's details, and how many sources say each.

    An inverted index: what sources say is counted by key before it meets the claims, so no claim is paired with a source.
    Of identifiers the sources' own are looked up; of phrases, every run of as many words as a claim's phrase has (their
    lengths, at most 50, come to the driver: a phrase is no longer than 100 characters)."""
    asked = claims.select(F.col(claim_id).alias("claim_id"), F.explode(details(claim)).alias("d")).select("claim_id", "d.*").distinct()
    lengths = asked.filter("kind = 'quoted'").select(F.size(F.split("key", " ")).alias("n")).distinct().orderBy("n")
    lengths = [row["n"] for row in lengths.collect()]
    rows = sources.select(F.col(source_id).alias("source_id"), F.coalesce(F.col(source), F.lit("")).alias("text"))
    entry = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    names = F.transform(F.filter(details("text"), lambda d: d["kind"] == "identifier"), lambda d: d["key"])
    held = [rows.select("source_id", F.explode(entry("number", spoken_numbers("text"))).alias("e")), rows.select("source_id", F.explode(entry("identifier", names)).alias("e"))]
    keys = asked.select("kind", "key").distinct()
    if lengths:
        words = rows.select("source_id", F.split(phrase_words("text"), " ").alias("w")).withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
        runs = words.filter(F.size("w") >= F.col("n")).select("source_id", F.explode(_runs("w", "n")).alias("key"))
        slots = keys.filter("kind = 'quoted'").select(_slot("key").alias("slot")).distinct()
        runs = runs.withColumn("slot", _slot("key")).join(F.broadcast(slots), "slot", "left_semi")
        held.append(runs.select("source_id", F.struct(F.lit("quoted").alias("kind"), "key").alias("e")))
    index = held[0]
    for more in held[1:]:
        index = index.unionByName(more)
    index = index.select("source_id", "e.*").join(keys, ["kind", "key"], "left_semi").distinct()
    index = index.groupBy("kind", "key").agg(F.count("*").alias("n_sources"), F.min("source_id").alias("first_source"))
    out = asked.join(index, ["kind", "key"], "left")
    return out.select("claim_id", "kind", "key", "strong", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "first_source")

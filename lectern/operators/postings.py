"""A stored index of trigrams behind keyword search: postings by trigram, looked up, verified, kept up to date by appending.

An index is a folder of two Parquet tables, written a version at a time:

- ``postings`` (version, bucket, gram, key, field): which fields hold a trigram, in folders by a hash of the trigram, in the order of
  trigrams within them, so that a search reads the buckets of its own trigrams and skips most of what they hold;
- ``keys`` (version, key, live, a size for each field): each row added, changed or taken out; of a key the latest version counts.

A change appends the changed keys' postings under a new version and rewrites nothing; a version written again replaces itself,
so a batch of a stream that is repeated counts once. ``rebuilt`` leaves out what is outdated. A search finds the rows that hold all
trigrams of a term in one field, and counts the term in the texts of those only: all others lack it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Of a term's trigrams those with the fewest postings are looked up, so many at most: the texts decide in the end.
RAREST = 4


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _low(field: str) -> Column:
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class PostingIndex:
    """An index of some text fields of rows with a key, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: tuple[str, ...], kind: str = "long"):
        """kind: the key's type."""
        self.spark, self.path, self.key, self.fields, self.kind = spark, path.rstrip("/"), key, fields, kind

    def add(self, docs: DataFrame, version: int = 0) -> None:
        """Index new or changed rows, one a key, under a version later than theirs before."""
        # One pass over a text: each match looks ahead at three characters and moves on by one.
        found = lambda f: F.array_distinct(F.regexp_extract_all(_low(f), F.lit(r"(?s)(?=(...))."), F.lit(1)))
        parts = [docs.select(F.col(self.key).alias("key"), F.lit(f).alias("field"), F.explode(found(f)).alias("gram")) for f in self.fields]
        postings = reduce(DataFrame.unionByName, parts).withColumn("bucket", _bucket(F.col("gram")))
        # Ranges of bucket, trigram and key: few files, and a frequent trigram is written by several tasks.
        postings = postings.repartitionByRange("bucket", "gram", "key").sortWithinPartitions("bucket", "gram", "key")
        postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        sizes = [F.length(_low(f)).cast("long").alias(f"{f}_size") for f in self.fields]
        self._note(docs.select(F.col(self.key).alias("key"), F.lit(True).alias("live"), *sizes), version)

    def remove(self, keys: DataFrame, version: int) -> None:
        """Take keys (one column) out of the index."""
        sizes = [F.lit(0).cast("long").alias(f"{f}_size") for f in self.fields]
        self._note(keys.select(F.col(keys.columns[0]).alias("key"), F.lit(False).alias("live"), *sizes), version)

    def _note(self, keys: DataFrame, version: int) -> None:
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/version={version}")

    def current(self) -> DataFrame:
        """key, version and sizes of the rows that are in the index."""
        keys = self.spark.read.parquet(f"{self.path}/keys")
        sizes = [f"{f}_size" for f in self.fields]
        latest = keys.groupBy("key").agg(F.max(F.struct("version", "live", *sizes)).alias("r"))
        return latest.filter("r.live").select("key", "r.version", *[f"r.{s}" for s in sizes])

    def postings(self, grams: list[str]) -> DataFrame:
        """Of these trigrams; only their buckets are read."""
        rows = self.spark.read.schema(f"key {self.kind}, field string, gram string, version int, bucket int").parquet(f"{self.path}/postings")
        buckets = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()
        return rows.filter(F.col("bucket").isin([b[0] for b in buckets]) & F.col("gram").isin(grams)).select("gram", "key", "field", "version")

    def candidates(self, terms: list[str]) -> DataFrame:
        """key of the rows with a field that holds the rarest trigrams of one of the terms (lower case, three letters or more)."""
        grams = sorted({g for t in terms for g in trigrams(t)})
        rows = self.postings(grams)
        counted = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.count("*").alias("n")).collect()}
        found = []
        for t in terms:
            rare = sorted(trigrams(t), key=lambda g: (counted.get(g, 0), g))[:RAREST]
            hits = rows.filter(F.col("gram").isin(rare)).groupBy("key", "field", "version").agg(F.count_distinct("gram").alias("n"))
            found.append(hits.filter(F.col("n") == len(rare)).select("key", "version"))
        hits = reduce(DataFrame.union, found).distinct()
        return hits.join(self.current().select("key", "version"), ["key", "version"]).select("key")

    def search(self, docs: DataFrame, terms: list[str], weights: dict[str, float], recency: str, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, score of the k best rows that hold every term: BM25 by field, ties to the newer; docs are the texts as they are now.

        Terms have three letters or more."""
        terms = [t.lower() for t in terms]
        if not terms or min(map(len, terms)) < 3:
            raise ValueError("an index of trigrams is asked for terms of three letters or more")
        stats = self.current().agg(F.count("*").alias("n"), *[F.avg(f"{f}_size").alias(f"{f}_avg") for f in self.fields])
        texts = docs.join(self.candidates(terms).select(F.col("key").alias(self.key)), self.key, "left_semi")
        quoted = lambda t: F.lit("".join("\\" + c if not c.isalnum() else c for c in t))
        counts = {(f, i): F.regexp_count(_low(f), quoted(t)).alias(f"{f}_{i}") for f in self.fields for i, t in enumerate(terms)}
        rows = texts.select(self.key, recency, *counts.values(), *[F.length(_low(f)).alias(f"{f}_size") for f in self.fields])
        # Rows that are no candidates hold no term: the counts of rows are those of the whole.
        held = rows.agg(*[F.count_if(F.col(f"{f}_{i}") > 0).alias(f"{f}_{i}_df") for f, i in counts])
        rows = rows.join(F.broadcast(stats.join(held)))
        every, score = F.lit(True), F.lit(0.0)
        for i in range(len(terms)):
            every = every & (reduce(Column.__add__, [F.col(f"{f}_{i}") for f in self.fields]) > 0)
        for f, i in counts:
            tf, df = F.col(f"{f}_{i}"), F.col(f"{f}_{i}_df")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            size = F.col(f"{f}_size") / F.coalesce(F.nullif(F.col(f"{f}_avg"), F.lit(0.0)), F.lit(1.0))
            score = score + weights[f] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size))
        best = rows.filter(every).select(self.key, recency, F.round(score, 9).alias("score"))
        return best.orderBy(F.desc("score"), F.desc(recency), self.key).limit(k).select(self.key, "score")

    def rebuilt(self, path: str, docs: DataFrame) -> PostingIndex:
        """A new index of the rows that are in this one, from their texts."""
        out = PostingIndex(self.spark, path, self.key, self.fields, self.kind)
        out.add(docs.join(self.current().select(F.col("key").alias(self.key)), self.key, "left_semi"))
        return out


def followed(stream: DataFrame, index: PostingIndex, checkpoint: str, first_version: int = 1):
    """A streaming query that indexes each batch's changed rows (of a key in one batch the last by ``at`` of its columns, if it has one)."""

    def one(batch: DataFrame, number: int) -> None:
        if "at" in batch.columns:
            batch = batch.groupBy(index.key).agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
        index.add(batch.dropDuplicates([index.key]), first_version + number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

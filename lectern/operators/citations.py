"""Citations: resolving references, scope checks, references found in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import url_key, video_id


def resolved(refs: DataFrame, docs: DataFrame, ref: str = "ref_id", shortest: int = 10) -> DataFrame:
    """ref_id, document_id, resolved_by of refs (ref_id, url, context, channel) against docs (document_id, video_id, url, title, channel).

    A video id comes first; then the address (one that misses ends the search); then the longest title the context
    holds; then the only document of the channel. Titles are matched by their first words, an equi-join, and then whole."""
    r = refs.withColumn("__video", video_id("url")).withColumn("__key", url_key("url"))
    by_video = r.join(docs.filter("video_id is not null").groupBy(F.col("video_id").alias("__video")).agg(F.min("document_id").alias("d1")), "__video", "left")
    by_url = by_video.join(docs.filter("url is not null").groupBy(url_key("url").alias("__key")).agg(F.min("document_id").alias("d2")), "__key", "left")
    first = lambda c: F.array_join(F.slice(F.split(F.lower(F.trim(c)), r"\s+"), 1, 2), " ")
    words = F.split(F.lower("context"), r"\s+")
    count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.concat(F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.concat_ws(" ", a, b)), words)
    asked = refs.filter("context is not null").select(ref, "context", F.explode(F.array_distinct(pairs)).alias("__head"))
    titled = docs.filter(F.length("title") >= shortest).select("document_id", "title", first(F.col("title")).alias("__head"))
    hits = asked.join(titled, "__head").filter(F.contains(F.lower("context"), F.lower("title")))
    title = hits.groupBy(ref).agg(F.max_by("document_id", F.struct(F.length("title"), -F.col("document_id"))).alias("d3"))
    sole = docs.groupBy("channel").agg(F.count("*").alias("n"), F.min("document_id").alias("d4")).filter("n = 1").drop("n")
    out = by_url.join(title, ref, "left").join(sole, "channel", "left")
    with_url = F.col("url").isNotNull() & (F.col("url") != "")
    found = F.when(F.col("d1").isNotNull(), F.struct(F.col("d1").alias("d"), F.lit("video").alias("by"))).when(with_url & F.col("d2").isNotNull(), F.struct(F.col("d2").alias("d"), F.lit("url").alias("by"))).when(with_url, F.struct(F.lit(None).cast("long").alias("d"), F.lit(None).cast("string").alias("by")))
    found = found.when(F.col("d3").isNotNull(), F.struct(F.col("d3").alias("d"), F.lit("title").alias("by"))).when(F.col("d4").isNotNull(), F.struct(F.col("d4").alias("d"), F.lit("channel").alias("by")))
    return out.withColumn("__f", found).select(ref, F.col("__f.d").alias("document_id"), F.col("__f.by").alias("resolved_by"))


def in_scope(refs: DataFrame, scope: DataFrame, key: str = "document_id") -> DataFrame:
    """References to visible documents, and those that name none; others go."""
    seen = scope.select(key).distinct().withColumn("__seen", F.lit(True))
    return refs.join(seen, key, "left").filter(F.col(key).isNull() | F.col("__seen")).drop("__seen")


def without_unknown(answer: str | Column, known: str | Column) -> Column:
    """[Source: x] marks of unknown names become [Source: unverified]; known: array of names, any case.

    The answer is cut at its marks and put together again, so that marks are checked one by one."""
    a = F.col(answer) if isinstance(answer, str) else answer
    names = F.transform(known, lambda k: F.lower(k))
    marks = F.regexp_extract_all(a, F.lit(r"\[Source: ([^\]]*)\]"), F.lit(1))
    between = F.split(a, r"\[Source: [^\]]*\]", -1)
    shown = F.transform(marks, lambda m: F.when(F.array_contains(names, F.lower(F.trim(m))), F.concat(F.lit("[Source: "), m, F.lit("]"))).otherwise(F.lit("[Source: unverified]")))
    return F.array_join(F.flatten(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda b, m: F.array(b, m))), "")


def history_hits(hits: DataFrame, exchange: str = "exchange_id", k: int = 5) -> DataFrame:
    """Nearest past answers, each exchange once."""
    w = Window.partitionBy(exchange).orderBy("distance", "id")
    return hits.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").orderBy("distance", "id").limit(k)


def cited_documents(refs: DataFrame, docs: DataFrame, ref: str = "ref_id") -> DataFrame:
    """ref_id, document_id: by video id, else by address without its fragment."""
    v = refs.withColumn("__v", video_id("url")).withColumn("__u", F.regexp_replace("url", "#.*$", ""))
    a = v.join(docs.filter("video_id is not null").groupBy(F.col("video_id").alias("__v")).agg(F.min("document_id").alias("a")), "__v", "left")
    b = a.join(docs.groupBy(F.regexp_replace("url", "#.*$", "").alias("__u")).agg(F.min("document_id").alias("b")), "__u", "left")
    return b.select(ref, F.coalesce("a", "b").alias("document_id")).filter("document_id is not null")

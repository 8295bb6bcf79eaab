"""Further selections, audits and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def context_around(moments: DataFrame, segments: DataFrame, source: str, at: str, start: str, text: str, around: float = 30, marker: float = 3) -> DataFrame:
    """Per moment (source, at): its segments within the window in order, those within the marker's reach set off by >>."""
    m = moments.withColumn("__b", F.explode(F.sequence(F.floor((F.col(at) - around) / around), F.floor((F.col(at) + around) / around))))
    s = segments.select(F.col(source), F.col(start).alias("__s"), F.col(text).alias("__t"), F.floor(F.col(start) / around).alias("__b"))
    hit = m.join(s, [source, "__b"]).filter(F.abs(F.col("__s") - F.col(at)) <= around)
    line = F.concat(F.when(F.abs(F.col("__s") - F.col(at)) <= marker, ">> ").otherwise(""), "__t")
    return hit.groupBy(source, at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__s", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def owned_segments(segments: DataFrame, parts: DataFrame, overlap: float) -> DataFrame:
    """Segments (part, start) of overlapping parts (part, part_start, length), each kept by one part: from half an overlap after its start to as much after its end; the first part is open below, the last above."""
    last = parts.agg(F.min("part").alias("__first"), F.max("part").alias("__last"))
    rows = segments.join(parts, "part").join(F.broadcast(last)).withColumn("at", F.col("part_start") + F.col("start"))
    low = (F.col("part") == F.col("__first")) | (F.col("at") >= F.col("part_start") + overlap / 2)
    high = (F.col("part") == F.col("__last")) | (F.col("at") < F.col("part_start") + F.col("length") + overlap / 2)
    return rows.filter(low & high).select(*segments.columns, "at")


def even_segments(df: DataFrame, key: str, text: str, duration: str, length: float) -> DataFrame:
    """round(duration / length) pseudo-segments of equally many words, the last with the rest."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.bround(F.col(duration) / length, 0).cast("int"), F.lit(1))
    rows = df.select(key, F.col(duration).alias("__d"), words.alias("__w"), n.alias("__n")).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    each = F.floor(F.size("__w") / F.col("__n")).cast("int")
    some = F.when(F.col("place") == F.col("__n") - 1, F.size("__w") - each * F.col("place")).otherwise(each)
    return rows.select(key, "place", (F.col("__d") / F.col("__n") * F.col("place")).alias("start"), F.array_join(F.slice("__w", each * F.col("place") + 1, F.greatest(some, F.lit(0))), " ").alias("text"))


def best_track(tracks: DataFrame, by: str, spoken: str, preferred: list[str]) -> DataFrame:
    """One track (code, generated, dubbed, place) per video: no dubs; the spoken language, a preferred one, English, any."""
    code = F.col("code")
    rank = F.when(code == F.col(spoken), 0).when(code.isin(preferred), 1).when(code == "en", 2).when(F.col("generated"), 3).otherwise(4)
    w = Window.partitionBy(by).orderBy(rank, "generated", "place")
    return tracks.filter(~F.col("dubbed")).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def topic_match(items: DataFrame, terms: list[str], title: str, body: str, place: str, n: int, share: float = 0.5) -> DataFrame:
    """Items with enough of the terms, by title hits, hits and place; filled up from the head of the feed."""
    hits = lambda c: sum([F.contains(F.lower(c), F.lit(t)).cast("int") for t in terms[1:]], F.contains(F.lower(c), F.lit(terms[0])).cast("int"))
    both = F.concat_ws(" ", title, body)
    need = -int(-(share * len(terms)) // 1)
    rows = items.withColumn("title_hits", hits(F.col(title))).withColumn("hits", hits(both)).withColumn("filled", F.col("hits") < need)
    zero = lambda c: F.when(F.col("filled"), 0).otherwise(-F.col(c))
    return rows.orderBy("filled", zero("title_hits"), zero("hits"), place).limit(n)


def flag_audit(docs: DataFrame, chunks: DataFrame, key: str, flag: str, source: str) -> DataFrame:
    """Per source: flagged without chunks, chunks without a flag, chunks of no document."""
    held = chunks.groupBy(key).agg(F.count("*").alias("__n"))
    both = docs.select(key, flag, source).join(held, key, "full")
    return both.groupBy(source).agg(F.count_if(F.col(flag) & F.col("__n").isNull()).alias("flagged_without_chunks"), F.count_if(~F.col(flag) & F.col("__n").isNotNull()).alias("chunks_without_flag"), F.coalesce(F.sum(F.when(F.col(flag).isNull(), F.col("__n"))), F.lit(0)).alias("orphan_chunks"))


def precedence_merge(rows: DataFrame, key: list[str], manual: Column, live: Column, *order: Column) -> DataFrame:
    """One row per key: a live manual one before a derived one; expired manual rows hold nothing."""
    w = Window.partitionBy(*key).orderBy(F.desc(manual & live), *order)
    return rows.filter(~manual | live).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def citation_numbers(rows: DataFrame, by: list[str], order: list[str], start: int = 1) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + start - 1)


def held_out(df: DataFrame, key: str, n: int, seed: int, least: int = 40) -> DataFrame:
    """n rows by a seeded hash of the key; none of a table smaller than the least."""
    big = df.agg((F.count("*") >= least).alias("__big"))
    return df.join(F.broadcast(big)).filter("__big").drop("__big").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def unseen_counts(rows: DataFrame, seen: DataFrame, user: str, at: str, state: str, lookback) -> DataFrame:
    """Per user and state the rows newer than the last look (or than the lookback)."""
    joined = rows.join(seen.select(user, "last_seen"), user, "left").filter(F.col(at) > F.coalesce("last_seen", F.lit(lookback).cast("timestamp_ntz")))
    return joined.groupBy(user, state).agg(F.count("*").alias("n"))


def digest_sections(sections: list[tuple[str, DataFrame, str, str]], since, until, cap: int) -> DataFrame:
    """section, id, at, place, total: the newest of each section in (since, until], with the section's full count."""
    out = None
    for name, df, key, at in sections:
        t = lambda x: F.lit(x).cast("timestamp_ntz")
        one = df.filter((F.col(at) > t(since)) & (F.col(at) <= t(until))).select(F.lit(name).alias("section"), F.col(key).cast("long").alias("id"), F.col(at).alias("at"))
        total = one.agg(F.count("*").alias("total"))
        one = one.orderBy(F.desc("at"), "id").limit(cap).join(F.broadcast(total)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "id")))
        out = one if out is None else out.unionByName(one)
    return out


def resurfaced(items: DataFrame, featured: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """Least recently featured first, the never featured before all."""
    last = featured.groupBy(key).agg(F.max(at).alias("last_at"))
    return items.join(last, key, "left").orderBy(F.asc_nulls_first("last_at"), key).limit(n)


def since_last(issues: DataFrame, at: str, until, default_days: int) -> DataFrame:
    """One row: since, the newest issue before until, else until less the default."""
    u = F.lit(until).cast("timestamp_ntz")
    return issues.agg(F.coalesce(F.max(F.when(F.col(at) < u, F.col(at))), u - F.expr(f"INTERVAL {default_days} DAYS")).alias("since"))


def custom_order(column: str, order: list[str]) -> Column:
    """Place in a given order, unknown values last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def until_seen(items: DataFrame, feed: str, place: str, id_col: str, cursors: DataFrame) -> DataFrame:
    """Items of newest-first feeds before the newest id seen (cursors: feed, seen_id); a feed whose id is gone, or new, is read whole."""
    stops = items.join(cursors.select(feed, F.col("seen_id").alias(id_col)), [feed, id_col], "left_semi").groupBy(feed).agg(F.min(place).alias("__stop"))
    return items.join(stops, feed, "left").filter(F.col("__stop").isNull() | (F.col(place) < F.col("__stop"))).drop("__stop")


def first_filled(*columns: str) -> Column:
    """The first of the columns that is not null and not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def any_named(df: DataFrame, column: str, name: str) -> bool:
    """Whether a row has the name, in any case."""
    return not df.filter(F.lower(column) == name.lower()).limit(1).isEmpty()

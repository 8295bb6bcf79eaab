"""Joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import bound


def first_match(df: DataFrame, tables: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Look a value up by one key after another: (key of df, table, key of the table); also which key found it."""
    out, values, names = df, [], []
    for i, (key, table, at) in enumerate(tables):
        side = table.groupBy(F.col(at).alias(f"__k{i}")).agg(F.min(value).alias(f"__v{i}"))
        out = out.join(side, F.col(key) == F.col(f"__k{i}"), "left")
        values.append(F.col(f"__v{i}"))
        names.append(F.when(F.col(f"__v{i}").isNotNull(), F.lit(key)))
    return out.select(*df.columns, F.coalesce(*values).alias(value), F.coalesce(*names).alias("resolved_by"))


def any_of_joins(df: DataFrame, key: str, sides: list[tuple[str, DataFrame]], chooser: str) -> DataFrame:
    """Rows whose table of choice holds them: a union of one inner join per table."""
    parts = [df.filter(F.col(chooser) == name).join(side.select(F.col(side.columns[0]).alias(key)).distinct(), key) for name, side in sides]
    return reduce(DataFrame.unionByName, parts)


def interleave(speech: DataFrame, notes: DataFrame, start: str, *ties: str) -> DataFrame:
    """Two timed tables with the same columns in one order; at the same time speech comes first."""
    both = speech.withColumn("is_note", F.lit(0)).unionByName(notes.withColumn("is_note", F.lit(1)))
    return both.orderBy(start, "is_note", *ties)


def nearest_in_window(anchors: DataFrame, spans: DataFrame, source: str, at: str, key: str, start: str, before: float = 30, after: float = 60, detail: Column | None = None, width: int | None = None) -> DataFrame:
    """Per anchor the span of its source nearest to it, within [at - before, at + after].

    Times are joined by equal time buckets of ``width`` seconds (each anchor looks at the few its window touches),
    so that a source with very many spans is not joined whole. An anchor without a time has no window: it gets its source's
    first span, without a distance."""
    width = width or int(before + after)
    untimed = anchors.filter(F.col(at).isNull())
    if detail is None:
        first = spans.groupBy(F.col(source).alias("__source")).agg(F.min(F.struct(F.col(start).alias("span_at"), "span_id")).alias("b"))
        untimed = untimed.join(first, F.col(source) == F.col("__source"))
    else:
        each = spans.select(F.col(source).alias("__source"), F.col(start).alias("span_at"), *[c for c in spans.columns if c not in (source, start)])
        untimed = untimed.join(each, F.col(source) == F.col("__source")).filter(detail).groupBy(key).agg(F.min(F.struct("span_at", "span_id")).alias("b"))
    untimed = untimed.select(key, F.col("b.span_id").alias("span_id"), F.lit(None).cast("double").alias("distance"))
    a = anchors.filter(F.col(at).isNotNull()).withColumn("__bucket", F.explode(F.sequence(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width))))
    s = spans.select(F.col(source).alias("__source"), F.col(start).alias("span_at"), F.col("span_id"), F.floor(F.col(start) / width).alias("__b"), *[c for c in spans.columns if c not in (source, start, "span_id")])
    hit = a.join(s, (F.col(source) == F.col("__source")) & (F.col("__bucket") == F.col("__b"))).filter((F.col("span_at") >= F.col(at) - before) & (F.col("span_at") <= F.col(at) + after))
    if detail is not None:
        hit = hit.filter(detail)
    best = hit.groupBy(key).agg(F.min(F.struct(F.abs(F.col("span_at") - F.col(at)).alias("distance"), "span_id")).alias("b"))
    return best.select(key, F.col("b.span_id").alias("span_id"), F.col("b.distance").cast("double").alias("distance")).unionByName(untimed)


def typed_targets(rows: DataFrame, lookups: list[tuple[str, DataFrame, str, str]], kind: str, target: str) -> DataFrame:
    """Join a polymorphic target: (kind, table, key, title) each, as one equi-join on (kind, id)."""
    every = reduce(DataFrame.unionByName, [t.select(F.lit(k).alias(kind), F.col(key).cast("string").alias(target), F.col(title).cast("string").alias("title")) for k, t, key, title in lookups])
    return rows.withColumn(target, F.col(target).cast("string")).join(every, [kind, target], "left")


#: Rows that one task counts in a table of its own, about: more of them make more tasks, not larger ones.
ROWS_A_TASK = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The tasks over which so many rows are dealt: the session's own number of them at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def pairs_within(df: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """Unordered pairs of items that share a group, with how many groups they share.

    Rows, then pairs, are dealt over as many tasks as their number calls for before they are counted, so that a task's memory
    does not grow with the input; the pairs' number is known from the groups' sizes."""
    spark = df.sparkSession
    dealt = df.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    rows = dealt.repartition(tasks_for(spark, df.count()), group).distinct()
    n = F.col("n").cast("double")
    pairs = int(rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0)
    other = rows.select(F.col(group), F.col(item).alias("other"))
    met = rows.join(other, group).filter(F.col(item) < F.col("other")).select(item, "other").repartition(tasks_for(spark, pairs), item, "other")
    return met.groupBy(item, "other").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def previous(df: DataFrame, by: list[str], order: list[str], *columns: str) -> DataFrame:
    """Each row with its group's preceding row's columns."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns])


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 1.0 where both are empty."""
    of = lambda union: F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))
    return bound(F.size(F.array_union(a, b)), of)


def scope_fingerprint(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """SHA-256 of a group's sorted distinct ids, one a line."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("fingerprint"))


def content_diff(desired: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """key and action: upsert, delete or unchanged, by the hash of the content."""
    d = desired.select(key, F.sha2(F.col(value).cast("string"), 256).alias("__new"))
    s = stored.select(key, F.sha2(F.col(value).cast("string"), 256).alias("__old"))
    action = F.when(F.col("__new").isNull(), "delete").when(F.col("__old").isNull() | (F.col("__old") != F.col("__new")), "upsert").otherwise("unchanged")
    return d.join(s, key, "full").select(key, action.alias("action"))


def field_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, change): gained where there was nothing, changed where it differs."""
    joined = before.alias("x").join(after.alias("y"), key)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"x.{c}").cast("string").alias("old"), F.col(f"y.{c}").cast("string").alias("new")) for c in columns])
    out = joined.select(key, F.explode(rows).alias("f")).filter(F.col("f.new").isNotNull() & ~F.col("f.new").eqNullSafe(F.col("f.old")))
    return out.select(key, "f.field", F.when(F.col("f.old").isNull() | (F.col("f.old") == ""), "gained").otherwise("changed").alias("change"))


def merged_tags(taggings: DataFrame, tag: str, target: str, source, into) -> DataFrame:
    """Move a tag's targets to another tag; those it has already fall away."""
    return taggings.withColumn(tag, F.when(F.col(tag) == source, F.lit(into)).otherwise(F.col(tag))).select(tag, target).distinct()


def insert_new(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, once each: INSERT ... ON CONFLICT DO NOTHING."""
    return rows.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def additive_upsert(stored: DataFrame, rows: DataFrame, key: list[str], amount: str) -> DataFrame:
    return stored.select(*key, amount).unionByName(rows.select(*key, amount)).groupBy(*key).agg(F.sum(amount).alias(amount))

"""Graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.relations import tasks_for
from lectern.operators.stored import checkpoints


def typed_edges(docs: DataFrame, topics: DataFrame, refs: DataFrame, floor: int = 2, per_doc: int = 8, tasks: int | None = None) -> DataFrame:
    """published_by, about and cites edges (source, target, kind, weight) of docs (doc, channel), topics (doc, topic, place) and refs (doc, cited).

    Each kind is counted by its keys, dealt over as many tasks as its rows call for (topics: over tasks, if given), and written out
    after that. The sides of joins that may have many rows to a key are streamed past a table of the other, not sorted."""
    spark = docs.sparkSession
    of_docs, of_refs, of_topics = tasks_for(spark, docs.count()), tasks_for(spark, refs.count()), tasks or tasks_for(spark, topics.count())
    common = topics.select("doc", "topic").distinct().groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") >= floor).select("topic")
    order = Window.partitionBy("doc").orderBy("place", "topic")
    about = topics.join(common.hint("shuffle_hash"), "topic", "left_semi").repartition(of_topics, "doc")
    about = about.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= per_doc)
    edge = lambda rows, s, t, k: rows.groupBy(s[1], t[1]).agg(F.count("*").alias("weight")).select(F.concat(F.lit(s[0]), F.col(s[1]).cast("string")).alias("source"), F.concat(F.lit(t[0]), F.col(t[1]).cast("string")).alias("target"), F.lit(k).alias("kind"), "weight")
    known = docs.select(F.col("doc").alias("cited")).repartition(max(of_docs, of_refs), "cited")
    cites = refs.filter("doc <> cited").repartition(max(of_docs, of_refs), "cited").join(known.hint("shuffle_hash"), "cited", "left_semi")
    every = edge(docs.filter("channel is not null").repartition(of_docs, "doc", "channel"), ("doc:", "doc"), ("channel:", "channel"), "published_by")
    every = every.unionByName(edge(about, ("doc:", "doc"), ("topic:", "topic"), "about"))
    return every.unionByName(edge(cites, ("doc:", "doc"), ("doc:", "cited"), "cites"))


def capped_pairs(pairs: DataFrame, a: str, b: str, weight: str, cap: int = 5) -> DataFrame:
    """Pairs (graph, a, b, weight) in order of weight, one skipped if either end already has cap of them.

    The greedy walk in rounds: a pair is kept once, at both ends, fewer than cap pairs kept or undecided come before it,
    and skipped once cap kept ones do at one end. The first undecided pair of a graph is settled in every round, and
    usually most are. Rounds are checkpointed."""
    checkpoints(pairs.sparkSession)
    order = [F.desc("w"), F.col("a"), F.col("b")]
    rows = pairs.select("graph", F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).cast("long").alias("w"), F.lit(False).alias("kept")).checkpoint()
    before = Window.partitionBy("graph", "node").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ends = rows.withColumn("node", F.explode(F.array("a", "b")))
        kept, every = F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)), F.count("*").over(before)
        seen = ends.withColumn("k", kept).withColumn("n", every).groupBy("graph", "a", "b", "w", "kept").agg(F.max("k").alias("k"), F.max("n").alias("n"))
        rows = seen.filter(F.col("kept") | (F.col("k") < cap)).withColumn("was", F.col("kept")).withColumn("kept", F.col("kept") | (F.col("n") < cap)).drop("k", "n").checkpoint()
        if rows.filter("not kept").isEmpty():
            break
        rows = rows.drop("was")
    return rows.select("graph", F.col("a").alias(a), F.col("b").alias(b), F.col("w").alias(weight))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct neighbours of every node."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a))
    return both.groupBy("node").agg(F.countDistinct("other").alias("degree"))


def neighborhood(edges: DataFrame, a: str, b: str, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, hops) within at most three steps of the seeds (one column of nodes)."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a)).distinct()
    seen = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, min(depth, 3) + 1):
        front = front.join(both, "node").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable.

    Every round points each node at the first of itself and its neighbours, in an order drawn anew by hash, follows that
    pointer once more, and replaces nodes by what they point at; edges within one node vanish, so that few are left after
    few rounds, long chains included. Rounds are checkpointed. At the end each group is named by its smallest node."""
    checkpoints(edges.sparkSession)
    left = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null").distinct().checkpoint()
    labels = left.select("x").union(left.select("y")).distinct().select(F.col("x").alias("node"), F.col("x").alias("label")).checkpoint()
    left, turn = left.filter("x <> y"), 0
    while not left.isEmpty():
        turn += 1
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c))  # noqa: B023, E731
        near = left.union(left.select("y", "x")).groupBy("x").agg(F.min(drawn("y")).alias("m"))
        first = near.select("x", F.when(F.col("m") < drawn("x"), F.col("m.y")).otherwise(F.col("x")).alias("to"))
        again = first.select(F.col("x").alias("to"), F.col("to").alias("further"))
        first = first.join(again, "to").select("x", F.col("further").alias("to")).checkpoint()
        labels = labels.join(first.select(F.col("x").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")).checkpoint()
        left = left.join(first.select("x", F.col("to").alias("u")), "x").join(first.select(F.col("x").alias("y"), F.col("to").alias("v")), "y")
        left = left.filter("u <> v").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct().checkpoint()
    named = labels.groupBy("label").agg(F.min("node").alias("component")).checkpoint()
    return labels.join(named, "label").select("node", "component")


def induced(edges: DataFrame, a: str, b: str, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    n = nodes.columns[0]
    return edges.join(nodes.select(F.col(n).alias(a)), a, "left_semi").join(nodes.select(F.col(n).alias(b)), b, "left_semi").select(*edges.columns)


def capped_subgraph(edges: DataFrame, a: str, b: str, nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame, dict]:
    """(edges between the first n of ordered nodes, those nodes, {total_nodes, total_edges, truncated})."""
    first = nodes.limit(n)
    total = nodes.count()
    return induced(edges, a, b, first), first, {"total_nodes": total, "total_edges": induced(edges, a, b, nodes).count(), "truncated": total > n}


def chosen_nodes(degree: DataFrame, recency: DataFrame, focus: list, n: int) -> DataFrame:
    """The focus first, then by degree, recency and id."""
    return degree.join(recency, "node", "left").orderBy(F.desc(F.col("node").isin(focus)), F.desc("degree"), F.desc_nulls_last("at"), "node").limit(n).select("node", "degree")

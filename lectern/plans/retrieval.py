"""Queries over vectors, keywords and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import graph, retrieval as op
from lectern.operators.postings import PostingIndex
from lectern.operators.relations import tasks_for
from lectern.operators.stored import shared_folder
from lectern.plans.registry import Tables, query

_COS = "round(1 - list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 12)"
_HITS = f"hits AS (SELECT v.vec_id AS id, v.label, {_COS} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id <> 0 AND v.vec_id % 3 <> 1)"


def _hits(t: Tables):
    """Vectors in scope and their distance to one of the table's, which is the request."""
    scope = t.embeddings.filter("vec_id % 3 <> 1 AND vec_id <> 0").select(F.col("vec_id").alias("id"), "label", "embedding")
    return op.distances(scope, "embedding", op.one_vector(t.embeddings.filter("vec_id = 0"), "embedding")).drop("embedding")


_TRUST = f"WITH {_HITS}, d AS (SELECT *, row_number() OVER (PARTITION BY id % 100 ORDER BY distance, id) AS r FROM hits WHERE distance <= 0.98) SELECT id, label, round(distance, 9) AS distance, round(distance / CASE WHEN w IS NULL THEN 1.0 ELSE least(greatest(w, 0.05), 2.0) END, 9) AS weighted FROM d LEFT JOIN (SELECT * FROM (VALUES (0, 2.0), (1, 0.0), (2, 9.0), (3, 0.5)) x(l, w)) ON label = l WHERE r = 1 ORDER BY distance / CASE WHEN w IS NULL THEN 1.0 ELSE least(greatest(w, 0.05), 2.0) END, id LIMIT 15"


@query("trust_rerank", _TRUST)
def trust_rerank(t: Tables):
    """Scoped, thresholded, trust-weighted retrieval with one hit per key: the flagship."""
    weights = t.spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 9.0), (3, 0.5)], "label int, weight double")
    hits = _hits(t).withColumn("key", F.col("id") % 100)
    out = op.trust_rerank(hits, weights, "label", "weight", 15, 0.98, "key")
    return out.select("id", "label", F.round("distance", 9).alias("distance"), F.round("weighted", 9).alias("weighted"))


@query("knn_scoped", f"SELECT q.vec_id AS query_id, v.vec_id AS id, round({_COS}, 9) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, v.vec_id) AS INT) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 5")
def knn_scoped(t: Tables):
    return op.nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), k=5).withColumn("distance", F.round("distance", 9))


@query("knn_squared_l2", "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 12), v.vec_id) AS INT) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 3")
def knn_squared_l2(t: Tables):
    return op.nearest(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), k=3, metric="squared_l2").withColumn("distance", F.round("distance", 9))


@query("pooled_lists", f"WITH a AS (SELECT v.vec_id AS id, {_COS} AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE v.vec_id <> 1 ORDER BY d, id LIMIT 20), b AS (SELECT v.vec_id AS id, {_COS} AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE v.vec_id <> 2 ORDER BY d, id LIMIT 20) SELECT id, round(min(d), 9) AS distance FROM (FROM a UNION ALL FROM b) GROUP BY 1 ORDER BY min(d), id LIMIT 12")
def pooled_lists(t: Tables):
    one = lambda i: op.nearest(t.embeddings, t.embeddings.filter(f"vec_id = {i}"), k=20).select("id", "distance")
    return op.pooled(one(1), one(2), 12).withColumn("distance", F.round("distance", 9))


@query("mean_vectors", "SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def mean_vectors(t: Tables):
    return op.mean_vector(t.embeddings, ["label"], "embedding").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query("mmr")
def mmr(t: Tables):
    rows = t.embeddings.withColumn("relevance", op.norm("embedding"))
    return op.mmr(rows, ["label"], "vec_id", "embedding", "relevance")


@query("centroid_spread")
def centroid_spread(t: Tables):
    return op.centroid_spread(t.embeddings, ["label"], "embedding", "vec_id")


def _bm25_sql(terms, fields, k):
    fs, ts = list(fields), list(enumerate(terms))
    cnt = ", ".join(f"len(regexp_extract_all(lower({f}), '{t}')) AS {f}_{i}" for f in fs for i, t in ts) + ", " + ", ".join(f"length({f}) AS {f}_size" for f in fs)
    st = ", ".join([f"avg({f}_size) AS {f}_avg" for f in fs] + [f"count(*) FILTER ({f}_{i} > 0) AS {f}_{i}_df" for f in fs for i, _ in ts])
    sc = " + ".join(f"{w} * ln(1 + (n - {f}_{i}_df + 0.5) / ({f}_{i}_df + 0.5)) * {f}_{i} * 2.2 / ({f}_{i} + 1.2 * (1 - 0.75 + 0.75 * {f}_size / {f}_avg))" for f, w in fields.items() for i, _ in ts)
    need = " AND ".join("(" + " + ".join(f"{f}_{i}" for f in fs) + ") > 0" for i, _ in ts)
    return f"WITH r AS (SELECT doc_id, {cnt} FROM (SELECT doc_id, left(text, 60) AS title, text FROM documents)), s AS (SELECT count(*) AS n, {st} FROM r) SELECT doc_id, round({sc}, 9) AS score FROM r, s WHERE {need} ORDER BY round({sc}, 9) DESC, doc_id DESC LIMIT {k}"


@query("bm25_search", _bm25_sql(["tion", "ther"], {"title": 5.0, "text": 1.0}, 20))
def bm25_search(t: Tables):
    docs = t.documents.select("doc_id", F.left("text", F.lit(60)).alias("title"), "text").withColumn("at", F.col("doc_id"))
    return op.bm25(docs, ["tion", "ther"], "doc_id", {"title": 5.0, "text": 1.0}, "at")


@query("indexed_search", _bm25_sql(["tion", "ther"], {"title": 5.0, "text": 1.0}, 20))
def indexed_search(t: Tables):
    """The search of bm25_search from a stored index of trigrams, which is built first."""
    docs = t.documents.select("doc_id", F.left("text", F.lit(60)).alias("title"), "text").withColumn("at", F.col("doc_id"))
    index = PostingIndex(t.spark, f"{shared_folder(t.spark)}/lectern/postings-{uuid.uuid4().hex}", "doc_id", ("title", "text"))
    index.add(docs)
    return index.search(docs, ["tion", "ther"], {"title": 5.0, "text": 1.0}, "at")


@query("grouped_search", "SELECT kind, id, title FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS title FROM customer WHERE contains(lower(c_name), '12') UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE contains(lower(p_name), '12') UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '12')) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id DESC) <= 10")
def grouped_search(t: Tables):
    from lectern.operators.filters import like_any
    from lectern.operators.ordering import best_per

    sides = [("customer", t.customer, "c_custkey", "c_name"), ("part", t.part, "p_partkey", "p_name"), ("supplier", t.supplier, "s_suppkey", "s_name")]
    out = None
    for kind, table, key, name in sides:
        one = table.filter(like_any("12", name)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("title"))
        out = one if out is None else out.unionByName(one)
    return best_per(out, ["kind"], F.desc("id"), n=10)


def _docs(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("channel"))


@query("graph_edges", "WITH x AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS topic, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS place FROM lineitem), k AS (SELECT topic FROM x GROUP BY 1 HAVING count(*) >= 2), a AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place, topic) AS r FROM x JOIN k USING (topic)), e AS (SELECT 'doc:' || o_orderkey AS source, 'channel:' || o_custkey AS target, 'published_by' AS kind FROM orders WHERE o_orderkey % 9 > 0 UNION ALL SELECT 'doc:' || doc, 'topic:' || topic, 'about' FROM a WHERE r <= 8 UNION ALL SELECT 'doc:' || o_orderkey, 'doc:' || (o_orderkey + 3), 'cites' FROM orders WHERE o_orderkey + 3 IN (SELECT o_orderkey FROM orders)) SELECT source, target, kind, count(*) AS weight FROM e GROUP BY 1, 2, 3")
def graph_edges(t: Tables):
    tasks = tasks_for(t.spark, t.lineitem.count())
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("topic"), "l_linenumber").repartition(tasks, "doc")
    topics = rows.groupBy("doc", "topic").agg(F.min("l_linenumber").alias("place"))
    refs = t.orders.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") + 3).alias("cited"))
    return graph.typed_edges(_docs(t), topics, refs, tasks=tasks)


_EDGES = "(SELECT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem)"


def _edges(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("a"), (1_000_000 + F.col("l_partkey")).alias("b"))


@query("graph_degrees", f"SELECT node, count(DISTINCT o) AS degree FROM (SELECT a AS node, b AS o FROM {_EDGES} UNION ALL SELECT b, a FROM {_EDGES}) GROUP BY 1")
def graph_degrees(t: Tables):
    return graph.degrees(_edges(t), "a", "b")


@query("graph_neighborhood", f"WITH RECURSIVE e AS (SELECT a AS node, b AS o FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), r AS (SELECT 5::BIGINT AS node, 0 AS hops UNION SELECT o, hops + 1 FROM r JOIN e USING (node) WHERE hops < 2) SELECT node, min(hops) AS hops FROM r GROUP BY 1")
def graph_neighborhood(t: Tables):
    return graph.neighborhood(_edges(t), "a", "b", t.spark.createDataFrame([(5,)], "node long"), 2)


@query("components", "WITH RECURSIVE e AS (SELECT user_id AS a, user_id + 1000 + CAST(floor(value) AS INT) % 3 AS b FROM events), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1")
def components(t: Tables):
    e = t.events.select(F.col("user_id").alias("a"), (F.col("user_id") + 1000 + F.col("value").cast("int") % 3).alias("b"))
    return graph.components(e, "a", "b")


@query("induced_subgraph", f"SELECT DISTINCT a, b FROM {_EDGES} WHERE a < 30 AND b - 1000000 < 400")
def induced_subgraph(t: Tables):
    e = _edges(t).distinct()
    nodes = e.select("a").filter("a < 30").union(e.select("b").filter("b - 1000000 < 400")).distinct()
    return graph.induced(e, "a", "b", nodes)


@query("capped_topic_pairs")
def capped_topic_pairs(t: Tables):
    from lectern.operators.relations import pairs_within

    pairs = pairs_within(t.lineitem, "l_orderkey", "l_suppkey", 2).withColumn("graph", F.lit(1))
    return graph.capped_pairs(pairs, "l_suppkey", "other", "n")

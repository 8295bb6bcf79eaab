"""Vector retrieval: distances, thresholds, trust-weighted order, selection, BM25."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lectern.operators.stored import checkpoints


#: Bytes of query vectors that one pass over all vectors takes along; more queries take more passes.
QUERY_BYTES = 32 << 20
#: Distances are rounded to so many places before they are compared, so that equal vectors tie.
PLACES = 12


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine, as an expression for single pairs; 1 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / size)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles; a null, or one of another length, is a zero vector."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width)), np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes == width):
        out[i] = flat[at[i] : at[i] + width]
    return out


def _distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Every row of q against every row of v. cosine: 1 where either is zero."""
    if metric == "squared_l2":
        # Summed dimension by dimension: a product of matrices would lose the small differences.
        out = np.zeros((len(q), len(v)))
        for d in range(v.shape[1]):
            out += np.square(q[:, d : d + 1] - v[:, d])
        return np.round(out, PLACES)
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
    return np.round(1 - np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size > 0), PLACES)


def one_vector(df: DataFrame, vector: str) -> list[float]:
    """The vector of a table's one row."""
    row = df.select(F.transform(vector, lambda x: x.cast("double"))).first()
    return list(row[0]) if row and row[0] else []


def distances(vectors: DataFrame, vector: str, query: list[float], metric: str = "cosine") -> DataFrame:
    """The rows of vectors, and the distance of each to one query vector."""
    q = np.array([query], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index(vector)), q.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_distances(v, q, metric)[0])], [*batch.schema.names, "distance"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("distance", DoubleType())]))


def clamped_weight(weight: str | Column, low: float = 0.05, high: float = 2.0) -> Column:
    """A trust weight in [0.05, 2]; 1 where it is unknown or no number."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.when(w.isNull() | F.isnan(w), 1.0).otherwise(F.least(F.greatest(w, F.lit(low)), F.lit(high)))


def _best_of(shared, k: int, threshold: float | None, metric: str, exclude_self: bool):
    """Of each Arrow batch, the k best rows of every query: (query_id, id, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            every = _matrix(batch.column(1), q.shape[1])
            for at in range(0, len(ids), 4096):
                some, v = ids[at : at + 4096], every[at : at + 4096]
                for lo in range(0, len(query_ids), 1024):
                    asked = query_ids[lo : lo + 1024]
                    d = _distances(v, q[lo : lo + 1024], metric)
                    if exclude_self:
                        d[asked[:, None] == some] = np.inf
                    if threshold is not None:
                        d[d > threshold] = np.inf
                    worst = np.partition(d, min(k, len(some)) - 1, axis=1)[:, min(k, len(some)) - 1]
                    i, j = np.nonzero((d <= worst[:, None]) & (d < np.inf))
                    order = np.lexsort((some[j], d[i, j], i))
                    i, j = i[order], j[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[nth < k], j[nth < k]
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(some[j]), pa.array(d[i, j])], ["query_id", "id", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 15, threshold: float | None = None, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """query_id, id, distance, rank: exact nearest neighbours of a stated set of queries over all vectors, ties by id.

    The queries go in blocks of at most QUERY_BYTES, each broadcast for one pass over the vectors, where a product of
    matrices gives the distances and only k rows a query and batch are shuffled. Rows without an id are left out."""
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("query_id is not null and v is not null")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null")
    size = q.agg(F.sum(F.size("v") * 8), F.max(F.size("v"))).first()
    blocks, found = max(1, -(-(size[0] or 0) // QUERY_BYTES)), None
    for block in range(blocks):
        asked = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = asked.toArrow()
        held = (rows["query_id"].to_numpy(), _matrix(rows["v"].combine_chunks(), size[1] or 1))
        best = v.mapInArrow(_best_of(v.sparkSession.sparkContext.broadcast(held), k, threshold, metric, exclude_self), "query_id long, id long, distance double")
        found = best if found is None else found.unionByName(best)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def trust_rerank(hits: DataFrame, weights: DataFrame, on: str, weight: str, k: int = 15, threshold: float = 0.6, key: str | None = None) -> DataFrame:
    """Threshold on the raw distance first, then order by distance / clamped weight: a weight reorders, it never admits.

    key: hits with the same key count once, at their smallest distance."""
    kept = hits.filter(F.col("distance") <= threshold)
    if key:
        first = Window.partitionBy(key).orderBy("distance", "id")
        kept = kept.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
    out = kept.join(weights.select(on, F.col(weight).alias("__w")), on, "left").withColumn("weighted", F.col("distance") / clamped_weight("__w")).drop("__w")
    return out.orderBy("weighted", "id").limit(k)


def pooled(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two ranked lists as one, by distance."""
    return a.unionByName(b).groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)


def mean_vector(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    parts = df.select(*by, F.posexplode(vector).alias("__i", "__x")).groupBy(*by, "__i").agg(F.avg("__x").alias("__m"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias("mean"))


def mmr(df: DataFrame, by: list[str], id_col: str, vector: str, relevance: str, k: int = 5, balance: float = 0.65, same: float = 0.86, asked: DataFrame | None = None, too_near: float = 0.88) -> DataFrame:
    """Maximal marginal relevance within a group of candidates: k rounds, each taking every group's best one.

    Candidates as like a taken one as ``same`` are dropped, as are those as like what was asked (by, vector) as ``too_near``.
    Ties go to the more relevant, then to the smaller id. A round moves one row a group, and is checkpointed."""
    checkpoints(df.sparkSession)
    cosine = lambda a, b: 1 - cosine_distance(a, b)
    rows = df.select(*by, id_col, F.col(vector).alias("__v"), F.col(relevance).cast("double").alias("__score"), F.lit(None).cast("double").alias("__like"))
    if asked is not None:
        rows = rows.join(asked.select(*by, F.col(vector).alias("__asked")), by, "left").filter(F.col("__asked").isNull() | (cosine("__v", "__asked") < too_near)).drop("__asked")
    rows, out = rows.checkpoint(), None
    for place in range(1, k + 1):
        value = balance * F.col("__score") - (1 - balance) * F.coalesce("__like", F.lit(0.0))
        best = F.min(F.struct((-value).alias("value"), (-F.col("__score")).alias("score"), F.col(id_col).alias("id"), F.col("__v").alias("v"))).alias("best")
        taken = rows.groupBy(*by).agg(best).select(*by, F.col("best.id").alias("__taken"), F.col("best.v").alias("__t")).checkpoint()
        one = taken.select(*by, F.col("__taken").alias(id_col), F.lit(place).cast("long").alias("place"))
        out = one if out is None else out.unionByName(one)
        if place == k or taken.isEmpty():
            break
        like = F.greatest("__like", cosine("__v", "__t"))
        rows = rows.join(taken, by).filter(F.col(id_col) != F.col("__taken")).withColumn("__like", like).filter(F.col("__like") < same).drop("__taken", "__t").checkpoint()
    return out


def _resampled(by: list[str], resamples: int, seed: int, kind: StructType):
    """Each batch's sums of vectors, one a group and resample (0: all rows once; else a row counts as often as a Poisson draw says)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            rows = []
            for key, part in frame.groupby(by, sort=False, dropna=False):
                part = part[part["v"].notna()]
                if not len(part):
                    continue
                v = np.array(part["v"].tolist(), float)
                times = np.ones((resamples + 1, len(v)))
                for i, h in enumerate(part["h"]):
                    times[1:, i] = np.random.RandomState((h ^ seed) & 0xFFFFFFFF).poisson(1.0, resamples)
                rows += [(*key, r, x) for r, x in enumerate(times @ v)]
            columns = list(zip(*rows)) if rows else [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, to_arrow_schema(kind).types)], names=kind.names)

    return run


def centroid_spread(df: DataFrame, by: list[str], vector: str, id_col: str, resamples: int = 50, seed: int = 7) -> DataFrame:
    """Mean cosine distance between the centroid of seeded resamples and the whole group's.

    A row's number of draws in a resample is Poisson with mean 1, seeded by its id: what drawing with replacement tends to,
    without a group having to be in one place. Partial sums are all that moves."""
    fields = df.select(*by).schema.fields
    kind = StructType([*fields, StructField("resample", IntegerType()), StructField("sums", ArrayType(DoubleType()))])
    parts = df.select(*by, F.col(vector).alias("v"), F.xxhash64(id_col).alias("h")).mapInArrow(_resampled(by, resamples, seed, kind), kind)
    sums = parts.select(*by, "resample", F.posexplode("sums").alias("i", "x")).groupBy(*by, "resample", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy(*by, "resample").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    whole = sums.filter("resample = 0").select(*by, F.col("c").alias("whole"))
    return sums.filter("resample > 0").join(whole, by).groupBy(*by).agg(F.avg(cosine_distance("c", "whole")).alias("spread"))


def bm25(docs: DataFrame, terms: list[str], id_col: str, fields: dict[str, float], recency: str, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: BM25 over substring terms (as a trigram index matches), a weight per field, ties to the newer; all terms must occur.

    One pass for the statistics (a single row), one for the scores. Terms of less than three letters are left out; with
    none longer, rows that hold every term come by recency, with the score 0. Without terms nothing is found."""
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    given = [t.lower() for t in terms if t.strip()]
    terms = [t for t in given if len(t) >= 3]
    newest = [F.desc("score"), F.desc(recency), F.col(id_col)]
    if not terms:
        every = F.lit(bool(given))
        for t in given:
            every = every & F.contains(F.concat_ws("\n", *low.values()), F.lit(t))
        return docs.filter(every).withColumn("score", F.lit(0.0)).orderBy(*newest).limit(k).select(id_col, "score")
    counts = {(f, i): F.regexp_count(low[f], F.lit("".join("\\" + c if not c.isalnum() else c for c in t))) for f in fields for i, t in enumerate(terms)}
    rows = docs.select(id_col, recency, *[c.alias(f"{f}_{i}") for (f, i), c in counts.items()], *[F.length(low[f]).alias(f"{f}_size") for f in fields])
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(f"{f}_size").alias(f"{f}_avg") for f in fields], *[F.count_if(F.col(f"{f}_{i}") > 0).alias(f"{f}_{i}_df") for f, i in counts]).first()
    every, score = F.lit(True), F.lit(0.0)
    for i in range(len(terms)):
        every = every & (sum([F.col(f"{f}_{i}") for f in fields][1:], F.col(f"{next(iter(fields))}_{i}")) > 0)
    for f, i in counts:
        tf, df = F.col(f"{f}_{i}"), stats[f"{f}_{i}_df"]
        idf = log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        score = score + fields[f] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"{f}_size") / F.lit(stats[f"{f}_avg"] or 1.0)))
    return rows.filter(every).select(id_col, recency, F.round(score, 9).alias("score")).orderBy(*newest).limit(k).select(id_col, "score")

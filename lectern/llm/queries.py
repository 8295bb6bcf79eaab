"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, media, periodic_runs, quality, simplex_clusters, token_store, toxicity, warc, winnowing
from lectern.llm.common import crc_remainder, documents
from lectern.llm.mixing import plan
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import best_fit_texts
from lectern.llm.secret_scan import RULES, listed, scan_in_runs


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_path = scan_in_runs(documents(spark, sf_dir))
    kinds = [r.kind for r in RULES if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return by_path.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), max_epochs=2.0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_texts(documents(spark, sf_dir))


def _with_split(scored: DataFrame, mod: int, out: int) -> DataFrame:
    return scored.select("doc_id", (crc_remainder("doc_id", mod) == out).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, crc_remainder("doc_id", 5) != 0)
    return _with_split(quality.score(docs, model), 5, 0)


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, crc_remainder("doc_id", 4) != 2)
    return _with_split(toxicity.passages(docs, model), 4, 2)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(documents(spark, sf_dir))
    return token_store.read(spark, path, with_ids=False)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.catalogue(spark, path)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.compare_with_edits(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        winnowing.digest("hashes", "positions").alias("fingerprint"),
        winnowing.digest("edited_hashes", "edited_positions").alias("edited_fingerprint"),
        winnowing.likeness("hashes", "edited_hashes").alias("near_edited"),
        winnowing.likeness("hashes", "next_hashes").alias("near_next"),
    )


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features_of(media.store_texts(documents(spark, sf_dir)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(documents(spark, sf_dir), plant=True, with_text=False)


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.grouped(documents(spark, sf_dir))


QUERIES = {
    "op11_periodic_runs": op11_periodic_runs,
    "op12_simplex_clusters": op12_simplex_clusters,
    "op13_exact_dedup": op13_exact_dedup,
    "op7_media_sniffing": op7_media_sniffing,
    "op3_winnowing": op3_winnowing,
    "op5_warc_archive": op5_warc_archive,
    "op1_token_store": op1_token_store,
    "op6_toxic_segments": op6_toxic_segments,
    "op4_quality_classifier": op4_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op8_temperature_mixing": op8_temperature_mixing,
    "op10_secret_ledger": op10_secret_ledger,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
}

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1])) END AS s
  FROM w
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets GROUP BY list_sort(s)
), items AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
shared AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS node, a AS r FROM edges
  UNION SELECT e.b, r.r FROM reach r JOIN edges e ON e.a = r.node
), component AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(m.c, k.rep) END AS component_id,
  s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(m.c, k.rep) END AS kept
FROM sets s LEFT JOIN classes k ON list_sort(s.s) = k.s LEFT JOIN component m ON m.node = k.rep
"""

def _span_sql(i: int, r) -> str:
    p = r.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0),
      o := {i}, n := length(regexp_extract_all(t, '{p}')[i]), k := '{r.kind}', g := length(regexp_extract_all(t, '{p}', {r.group})[i]))), lambda x: x.g >= {r.least})"""


_OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{", ".join(_span_sql(i, r) for i, r in enumerate(RULES))}])) AS s FROM d),
b AS (SELECT doc_id, s, list_filter(s, lambda x: x.o < 3) AS b FROM f)
SELECT doc_id, CAST(len(list_filter(b, lambda x: x.o = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(b, lambda x: x.o = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(b, lambda x: x.o = 2)) AS BIGINT) AS n_hex,
  sha256(array_to_string(list_transform(b, lambda x: x.k || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ',')) AS base_sha256,
  array_to_string(list_transform(s, lambda x: x.k || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ',') AS spans
FROM b
"""

_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_OP8_SQL = f"""
WITH RECURSIVE items AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(ceil(octet_length(encode(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) / 2.75::DOUBLE) AS BIGINT) AS n_tokens FROM documents
), sums AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n FROM items GROUP BY 1),
shares AS (SELECT list({{'p': tokens / (SELECT sum(tokens) FROM sums), 't': tokens}}) AS s FROM sums WHERE tokens > 0),
ratio AS (SELECT list_max(list_transform(s, lambda x: x.p)) AS hi, list_min(list_transform(s, lambda x: x.p)) AS lo, s FROM shares),
halves AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, list_max(list_transform(s, lambda x: pow(x.p, (low + high) / 2) / x.t)) / list_min(list_transform(s, lambda x: pow(x.p, (low + high) / 2) / x.t)) <= 2.0 AS ok FROM halves, ratio WHERE i < 32)
), a AS (
  SELECT CASE WHEN hi / lo <= 2.0 THEN 0.0 ELSE (SELECT ceil(high * 1000000) / 1000000 FROM halves ORDER BY i DESC LIMIT 1) END AS a FROM ratio
), powers AS (SELECT source, tokens, n, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM sums), (SELECT a FROM a)) ELSE 0.0 END AS w FROM sums),
rates AS (SELECT source, tokens, n, w / (SELECT sum(w) FROM powers) AS weight, CASE WHEN tokens > 0 THEN w / tokens / (SELECT min(w / tokens) FROM powers WHERE tokens > 0) ELSE 1.0 END AS rate FROM powers),
sources AS (SELECT source, weight, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * tokens) AS BIGINT) AS part, CAST(ceil(sqrt(n)) AS BIGINT) AS blocks FROM rates),
placed AS (SELECT i.*, weight, whole, part, {_DRAW.format("'17:' || doc_id")} % blocks AS block FROM items i JOIN sources USING (source)),
sized AS (SELECT source, block, whole, part, sum(n_tokens) AS size, unnest(range(0, whole + 1)) AS epoch FROM placed GROUP BY source, block, whole, part),
ranked AS (SELECT *, {_DRAW.format("'17:' || source || ':' || epoch || ':' || block")} AS d FROM sized),
ordered AS (SELECT *, row_number() OVER w AS block_rank, sum(size) OVER w - size AS before FROM ranked WINDOW w AS (PARTITION BY source, epoch ORDER BY d, block)),
copies AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM placed),
drawn AS (SELECT c.*, block_rank, before, {_DRAW.format("'17:' || epoch || ':' || doc_id")} AS d FROM copies c JOIN (SELECT source, epoch, block, block_rank, before FROM ordered WHERE epoch < whole OR before < part) USING (source, epoch, block)),
slots AS (SELECT *, row_number() OVER w AS slot, before + sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY d, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM drawn WINDOW w AS (PARTITION BY source, epoch, block ORDER BY d, doc_id, n_tokens))
SELECT doc_id, source, n_tokens, epoch, block, CAST(block_rank AS INT) AS block_rank, CAST(slot AS INT) AS slot, weight FROM slots WHERE epoch < whole OR upto <= part
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP5_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}', CAST(1 + ((CAST('0x' || substr(x || '0', 1 + (i * 5) // 4, 2) AS BIGINT) >> (3 - (i * 5) % 4)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

_OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(n) OVER w AS most, count(*) OVER (PARTITION BY t) AS group_size
  FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n = most AS kept, sha256(t) AS text_sha256 FROM g
"""


def _op12_sql(k: int = simplex_clusters.K, rounds: int = simplex_clusters.ROUNDS) -> str:
    """Rounds of assignment and means, one after the other; distances in integers."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM kept ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT v.vec_id, v.x, c.c, {distance} AS d FROM kept v CROSS JOIN c{r} c)""")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS m FROM d{r} GROUP BY vec_id, x)")
        if r < rounds:
            cells = f"SELECT a.m.c AS c, i, sum(a.x[i]) AS s, count(*) AS n FROM (SELECT k.x, a.m FROM kept k JOIN a{r} a ON a.vec_id IS NOT DISTINCT FROM k.vec_id AND a.x = k.x) a, range(1, 65) t(i) GROUP BY 1, 2"
            means = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM ({cells}) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({means}) m ON m.c = c.c)")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, CAST(a.m.c AS INT) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a ON a.vec_id IS NOT DISTINCT FROM k.vec_id AND a.x = k.x JOIN c{rounds} c ON c.c = a.m.c"""


ORACLES = {
    "op12_simplex_clusters": _op12_sql(),
    "op13_exact_dedup": _OP13_SQL,
    "op5_warc_archive": _OP5_SQL,
    "op8_temperature_mixing": _OP8_SQL,
    "op10_secret_ledger": _OP10_SQL,
    "op9_minhash_near_dedup": _OP9_SQL,
}

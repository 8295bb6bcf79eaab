"""Exact duplicates by skew-safe combining.

Two texts are equal when they are identical after deleting the characters ``[\\x20\\x09-\\x0D]``. Of equal texts the row
with the most code points stays, then that with the smallest id.

1. Locally: every task groups its own rows by the digest (SHA-256) and the whole content, before anything is sent; a group
   of copies leaves a task as one row.
2. Salted: these rows meet by digest, content and salt, which is drawn from the number of the task, so that a group that
   every task has is merged by ``SALTS`` tasks.
3. Globally: the winners of the salts, at most ``SALTS`` of a group, meet by digest and content.

Every stage compares the whole content, so a collision of digests only makes a digest with two groups (``digest`` may be
any function of the content; the tests use one that collides). Rows then find their group by digest alone, where it has
one group: all rows of it were compared in full by then; where it has several, by content too. Groups with more than an
``MANY``-th of all rows, of which there are fewer than ``MANY``, are broadcast; the others are joined by a shuffle.

Defined cases: a null text counts as empty, and empty texts are equal to each other; very long texts are compared
whole; of repeated rows (same id, same length) each counts as a row that stays in ``grouped``, and one stays in
``deduplicated``; a row without an id loses ties against rows with one, and keep_id is null where it stays; an empty table
gives an empty result; other columns, whatever their names, are carried by ``deduplicated`` and not read by ``grouped``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import stored, unused

SALTS, MANY = 16, 1000
SPACE = r"[\x20\x09-\x0D]+"


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _rank(n_chars: str, row_id: str) -> Column:
    """Larger is better: more code points, an id at all, the smaller id (~id never overflows)."""
    return F.struct(F.col(n_chars).alias("n_chars"), F.col(row_id).isNotNull().alias("named"), F.bitwise_not(F.col(row_id)).alias("not_id"))


def groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, content or null, best, group_size, variants) of rows (digest, content, n_chars, row_id), stored: content only where a digest has several.

    Contents are sent twice, to the tasks of the salts and to those of the digests, and are not stored."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.max(_rank("n_chars", "row_id")).alias("best"), F.count("*").alias("n"))
    combined = merged.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    # The rows of a digest lie together by now, in order: no further exchange.
    combined = combined.withColumn("variants", F.count("*").over(Window.partitionBy("digest")))
    return stored(combined.withColumn("content", F.when(F.col("variants") > 1, F.col("content"))), "exact_groups")


def _with_groups(rows: DataFrame, found: DataFrame, many: int = MANY) -> DataFrame:
    """rows (digest, content, ...) without content, with best and group_size of their group."""
    plain = stored(rows.drop("content"), "exact_rows")
    total, most = found.agg(F.sum("group_size"), F.max("variants")).first()
    one = found.filter("variants = 1").select("digest", "best", "group_size")
    large = F.col("group_size") * many > F.lit(total or 0)
    out = plain.join(F.broadcast(one.filter(large)), "digest")
    rest = plain.join(F.broadcast(one.filter(large).select("digest")), "digest", "left_anti")
    out = out.unionByName(rest.join(one.filter(~large), "digest"))
    if (most or 1) > 1:
        apart = found.filter("variants > 1").select("digest", "content", "best", "group_size")
        out = out.unionByName(rows.join(apart, ["digest", "content"]).drop("content"))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), content(text).alias("content"), *more)
    return rows.withColumn("digest", digest(F.col("content")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS, many: int = MANY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space) for every row of docs."""
    rows = _rows(docs, id_col, text_col, digest)
    found = groups(rows, salts)
    text_sha256 = F.col("digest") if digest is sha256 else F.col("text_sha256")
    wanted = rows if digest is sha256 else rows.withColumn("text_sha256", sha256(F.col("content")))
    out = _with_groups(wanted, found, many)
    keep_id = F.when(F.col("best.named"), F.bitwise_not(F.col("best.not_id")))
    kept = F.col("row_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("best.n_chars"))
    return out.select(F.col("row_id").alias("doc_id"), keep_id.alias("keep_id"), "group_size", kept.alias("kept"), text_sha256.alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, each once: of rows that tie in id and length, that with the smallest hash of its text."""
    digest, n_chars, named, not_id, whole = unused(docs, "__digest", "__n_chars", "__named", "__not_id", "__content")
    row_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    address = {n_chars: F.char_length(text).cast("long"), named: row_id.isNotNull(), not_id: F.coalesce(F.bitwise_not(row_id), F.lit(0))}
    found = groups(_rows(docs, id_col, text_col, sha256))
    winners = found.select(F.col("digest").alias(digest), F.col("best.n_chars").alias(n_chars), F.col("best.named").alias(named), F.coalesce("best.not_id", F.lit(0)).alias(not_id), F.col("content").alias(whole))
    # The id is part of the key: the rows of a large group don't meet.
    hit = docs.withColumns({digest: sha256(content(F.col(text_col))), **address}).join(winners, [digest, n_chars, named, not_id])
    hit = hit.filter(F.col(whole).isNull() | (F.col(whole) == content(F.col(text_col))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return hit.groupBy(digest, whole).agg(F.min_by(row, F.xxhash64(text)).alias(digest[:-6] + "row")).select(f"{digest[:-6]}row.*")

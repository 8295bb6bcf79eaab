"""Scopes and predicates. An empty scope gives nothing, never everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(docs: DataFrame, grants: DataFrame, tenant, key: str = "document_id", tenant_col: str = "tenant_id") -> DataFrame:
    """Rows one tenant may see, by a semi join on the grants."""
    return docs.join(grants.filter(F.col(tenant_col) == tenant).select(key), key, "left_semi")


def in_scope(df: DataFrame, key: str, scope: list | DataFrame | None) -> DataFrame:
    """None is everything; a list or a table of ids restricts, an empty one to nothing."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        return df.join(scope.select(F.col(scope.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(scope)) if scope else df.filter(F.lit(False))


def escaped(text: str) -> str:
    """A LIKE pattern's literal text."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_any(text: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return found


def match_terms(query: str, column: str, shortest: int = 3) -> Column | None:
    """All terms of at least three characters are contained; None where no term is long enough."""
    terms = [w for w in query.split() if len(w) >= shortest]
    if not terms:
        return None
    out = F.lit(True)
    for w in terms:
        out = out & F.contains(F.lower(column), F.lit(w.lower()))
    return out


def half_open(column: str, since, until) -> Column:
    """since < column <= until."""
    return (F.col(column) > F.lit(since)) & (F.col(column) <= F.lit(until))


def duration_gate(df: DataFrame, seconds: str, preferred: Column, least_minutes: float | None = None, most_minutes: float | None = None, short: int = 120) -> DataFrame:
    """kept and dropped_as_short flags. Without a minimum, known lengths under ``short`` seconds go unless preferred."""
    s = F.col(seconds)
    is_short = F.lit(False) if least_minutes is not None else F.coalesce((s > 0) & (s < short), F.lit(False)) & ~preferred
    keep = ~is_short
    if least_minutes is not None:
        keep = keep & F.coalesce(s >= least_minutes * 60, F.lit(False))
    if most_minutes is not None:
        keep = keep & F.coalesce(s <= most_minutes * 60, F.lit(False))
    return df.withColumn("kept", keep).withColumn("dropped_as_short", is_short)


def live(deleted_at: str | None = None, expires_at: str | None = None, suppressed_at: str | None = None, now=None) -> Column:
    out = F.lit(True)
    if deleted_at:
        out = out & F.col(deleted_at).isNull()
    if suppressed_at:
        out = out & F.col(suppressed_at).isNull()
    if expires_at:
        out = out & (F.col(expires_at).isNull() | (F.col(expires_at) > F.lit(now)))
    return out


def due(now, lease_minutes: int, enabled: str = "enabled", next_run: str = "next_run_at", claimed: str = "claimed_at") -> Column:
    """Enabled, due, and not held by a fresh lease."""
    stale = F.col(claimed).isNull() | (F.col(claimed) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {lease_minutes} MINUTES"))
    return F.col(enabled) & (F.col(next_run) <= F.lit(now).cast("timestamp_ntz")) & stale


def json_member(column: str, path: str, value: str) -> Column:
    """The parsed value decides; malformed JSON has no members."""
    return F.coalesce(F.get_json_object(column, path) == value, F.lit(False))


def keyset_page(df: DataFrame, order: str, key: str, before, n: int) -> DataFrame:
    """The n newest rows before an instant; the key breaks ties."""
    return df.filter(F.col(order) < F.lit(before)).orderBy(F.desc(order), F.desc(key)).limit(n)


def page(df: DataFrame, *order: Column, offset: int = 0, n: int = 20) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def fresh_chunks(chunks: DataFrame, doc: str = "document_id", index: str = "chunk_index", total: str = "total_chunks") -> DataFrame:
    """Chunk 0's total rules: rows beyond it, or of another total, are stale. Without it all stay."""
    first = chunks.filter(F.col(index) == 0).groupBy(F.col(doc)).agg(F.max(total).alias("__total"))
    joined = chunks.join(first, doc, "left")
    return joined.filter(F.col("__total").isNull() | ((F.col(index) < F.col("__total")) & (F.col(total) == F.col("__total")))).drop("__total")

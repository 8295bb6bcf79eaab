"""Stateful ingest as Structured Streaming: idempotent merges, incremental cursors, sessions, limits, derived tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A folder's files as a stream, some at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def kept_rows(batches: DataFrame, key: list[str], content: list[str], number: str = "batch") -> DataFrame:
    """The table that rows of numbered batches, one a key and batch, amount to: of each key the row of its last change of content."""
    w = Window.partitionBy(*key).orderBy(number)
    same = F.lag(F.lit(1)).over(w).isNotNull()
    for c in content:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    changed = batches.withColumn("__same", same).filter("not __same").drop("__same")
    row = F.struct(*[c for c in batches.columns if c not in (number, *key)])
    return changed.groupBy(*key).agg(F.max_by(row, number).alias("row")).select(*key, "row.*")


def merged_events(stored: DataFrame, batch: DataFrame, key: list[str], order: list[str], content: list[str]) -> DataFrame:
    """Stored rows and the batch's last row of each key, with what became of it: added, updated, unchanged or kept."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    last = batch.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    both = stored.select(F.struct(*stored.columns).alias("old"), *key).join(last.select(F.struct(*stored.columns).alias("new"), *key), key, "full")
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(same, "unchanged").otherwise("updated")
    row = F.when(F.col("new").isNull() | same, F.coalesce("old", "new")).otherwise(F.col("new"))
    return both.select(change.alias("change"), row.alias("row")).select("change", "row.*")


def ingest(stream: DataFrame, path: str, key: list[str], order: list[str], content: list[str]) -> DataFrame:
    """Run what there is to read. Every batch adds a folder with the last row of each of its keys; reading reduces them.

    A batch that is run again writes its folder again, so it changes nothing; late rows simply merge. No batch rewrites what
    others wrote: a folder holds what came, and the table is what ``kept_rows`` makes of all."""
    spark, columns = stream.sparkSession, stream.columns

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in columns if c not in key]), F.struct(*order)).alias("row")).select(*key, "row.*")
        last.select(*columns).write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/table/batch=-1")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kind = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return kept_rows(spark.read.schema(kind).parquet(f"{path}/table"), key, content).select(*columns)


def summed(stream: DataFrame, path: str, key: list[str], amount: str) -> DataFrame:
    """A ledger: key and the sum of an amount over all batches so far. Every batch writes its own sums to its own folder, so a
    batch that failed half-way and is run again counts once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(F.sum(amount).alias(amount)).write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    kind = spark.createDataFrame([], stream.schema).groupBy(*key).agg(F.sum(amount).alias(amount)).schema
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/table/batch=-1")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kind).parquet(f"{path}/table").groupBy(*key).agg(F.sum(amount).alias(amount))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is into a Parquet table with its own checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts and sums per tumbling window; a window closes when the watermark has passed it."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(F.window("__at", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "value")


def gap_sessions(stream: DataFrame, at: str, gap: str, late: str, *by: str) -> DataFrame:
    """Sessions by gap alone."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(F.session_window("__at", gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def distinct_events(stream: DataFrame, at: str, late: str, key: list[str]) -> DataFrame:
    """The first of each key within the watermark: for sources that only add."""
    return stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(key).drop("__at")


def limited(df: DataFrame, key: list[str], at: str, seconds: int, limit: int, *ties: str) -> DataFrame:
    """allowed: the first calls of each fixed window. Refused calls do not count."""
    bucket = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / seconds)
    w = Window.partitionBy(*key, "__bucket").orderBy(at, *ties)
    return df.withColumn("__bucket", bucket).withColumn("allowed", F.row_number().over(w) <= limit).drop("__bucket")


def change_votes(stream: DataFrame, search: str, ids: str, at: str, least: float = 0.5) -> DataFrame:
    """Per search and run: first, unchanged (same fingerprint, nothing compared), similar or changed by Jaccard.

    The state is the last run's ids; a run no newer than it is left out."""

    def vote(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(at)
        for r in rows.itertuples(index=False):
            when, now = int(pd.Timestamp(getattr(r, at)).value // 1000), sorted(set(getattr(r, ids)))
            if seen is not None and when <= seen:
                continue
            if last is None:
                verdict, j = "first", None
            elif list(last) == now:
                verdict, j = "unchanged", 1.0
            else:
                a, b = set(last), set(now)
                j = len(a & b) / len(a | b)
                verdict = "similar" if j >= least else "changed"
            out.append((key[0], getattr(r, at), verdict, j))
            last, seen = now, when
        state.update((list(last or []), seen or 0))
        yield pd.DataFrame(out, columns=[search, at, "verdict", "jaccard"])

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.select(search, at, ids).groupBy(search).applyInPandasWithState(vote, f"{search} {kind[search]}, {at} {kind[at]}, verdict string, jaccard double", "last array<string>, seen long", "append", GroupStateTimeout.NoTimeout)


def since_cursor(items: DataFrame, cursor: DataFrame, key: str, at: str, started: Column) -> tuple[DataFrame, DataFrame]:
    """(items newer than their source's cursor, the cursors to keep once they are stored).

    The new cursor is the time the sync STARTED, so that nothing that came meanwhile is missed; a source without a cursor is read whole."""
    fresh = items.join(cursor, key, "left").filter(F.col("last_sync_at").isNull() | (F.col(at) > F.col("last_sync_at"))).drop("last_sync_at")
    after = items.select(key).distinct().union(cursor.select(key)).distinct().withColumn("last_sync_at", started)
    return fresh, after


def refreshed_index(index: DataFrame, changed: DataFrame, key: str, build) -> DataFrame:
    """A derived table with only the changed keys built again."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(build(changed).select(*index.columns))


def next_state(rows: DataFrame, now, lease_minutes: int = 15, most_failures: int = 5) -> DataFrame:
    """One scheduler tick as a function of rows (enabled, next_run_at, claimed_at, failures, result): claim, dispatch, advance, retry, disable."""
    t = F.lit(now).cast("timestamp_ntz")
    stale = F.col("claimed_at").isNull() | (F.col("claimed_at") < t - F.expr(f"INTERVAL {lease_minutes} MINUTES"))
    due = F.col("enabled") & (F.col("next_run_at") <= t) & stale
    failures = F.when(F.col("result") == "failed", F.col("failures") + 1).when(F.col("result") == "ok", 0).otherwise(F.col("failures"))
    action = F.when(F.col("result") == "ok", "advance").when((F.col("result") == "failed") & (failures >= most_failures), "disable").when(F.col("result") == "failed", "retry").when(due, "claim").otherwise("wait")
    return rows.withColumn("action", action).withColumn("failures", failures).withColumn("claimed_at", F.when(F.col("action") == "claim", t).when(F.col("action") == "wait", F.col("claimed_at"))).withColumn("enabled", F.col("enabled") & (F.col("action") != "disable"))

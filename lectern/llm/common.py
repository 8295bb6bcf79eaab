"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For a session that runs on one machine and names no folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only for a session on one machine that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SHARED_DIR)
        found = LOCAL_SHARED_DIR
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run, stored in a folder of their own in the shared folder, each until it is dropped.

    A table may go only when nothing that is still to be computed reads it: what was made of it is stored too."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.written = spark, new_path(spark, name), {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        held = self.written.setdefault(name, [])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df = stored(df, name, path)
        held.append(path)
        return df

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Store a table, then drop those of the same name before it."""
        old = self.written.pop(name, [])
        df = self.store(df, name)
        self._remove(old)
        return df

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.written.pop(name, []))

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod: the fixed split of labelled rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % mod


def split_batches(batches, column: str, most_bytes: int = 32 << 20):
    """Arrow batches cut to a bounded number of text bytes (a single longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        if batch.column(i).nbytes <= most_bytes:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and batch.column(i).slice(at, n).nbytes > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n

"""The training-data pipeline over documents: quality, near-duplicates, secrets, mixing, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents:

1. quality: documents scored under ``LEAST_QUALITY`` go. The classifier learns from the labelled rows whose
   crc32(doc_id as text) mod 5 is not 0.
2. near_dedup: of every group linked by 5-word shingles at similarity 0.8 the row with the smallest doc_id stays, once.
3. secrets: every secret found in a text is replaced by a mark, and n_chars follows.
4. mixing: every document stays; those of small sources are repeated, up to ``MAX_EPOCHS`` times.
5. packing: one row per document (each copy) and piece, with its place in a sequence.

Stage 5 counts token ids, as op1_token_store does; a text without ids counts 0. Stage 4 is native and estimates them
from the bytes of a text (``mixing.token_estimate``).

Defined cases: a null text counts as the empty text in every stage and stays null; rows without a doc_id are
documents like others, but the last to stay of a group; rows that share a doc_id but not a text are documents of
their own (repeated rows are copies); texts without a word all stay; very long texts are scored, compared and redacted
whole, and packed in pieces; ties go to the smaller id, then the smaller hash of the text; further columns, whatever
their names, are carried up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, quality, secret_scan
from lectern.llm.common import Scratch, crc_remainder, documents, unused
from lectern.llm.near_dedup import kept_rows

LEAST_QUALITY = 0.3
MAX_EPOCHS = 2.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, crc_remainder("doc_id", 5) != 0)
    (score,) = unused(docs, "__score")
    scored = quality.scored_rows(docs, model, name=score)
    return scored.filter(F.col(score) >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, shingle=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, max_epochs=MAX_EPOCHS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_texts(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't train the classifier: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes once the next one's is written."""
    docs, scratch, before = documents(spark, sf_dir), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs

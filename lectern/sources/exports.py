"""Sinks: training rows, notes, archives, idempotent and additive writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def qa_rows(exchanges: list[DataFrame], tenant) -> DataFrame:
    """question, answer, created_at of one tenant from several tables, oldest first."""
    parts = [e.filter(F.col("tenant_id") == tenant).select("question", "answer", "created_at") for e in exchanges]
    return reduce(DataFrame.unionByName, parts).orderBy("created_at", "question")


def paired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn with the assistant's that follows it."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("__next", F.lead(role).over(w)).withColumn("answer", F.lead(text).over(w))
    return rows.filter((F.col(role) == "user") & (F.col("__next") == "assistant")).select(conv, turn, F.col(text).alias("question"), "answer")


def chat_json(system: str, user: str | Column, assistant: str | Column) -> Column:
    """{"messages": [system, user, assistant]} as one JSON line."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), (F.col(c) if isinstance(c, str) else c).alias("content"))
    return F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", user), message("assistant", assistant)).alias("messages")))


def tuple_json(system: str, user: str | Column, assistant: str | Column) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.to_json(F.struct(F.lit(system).alias("system"), c(user).alias("user"), c(assistant).alias("assistant")))


def knowledge_prompt(topics: str, concepts: str, events: str) -> Column:
    """Tell me about: a, b (also related concepts: ..., events: ...)"""
    extra = F.concat_ws(", ", F.when(F.size(concepts) > 0, F.concat(F.lit("related concepts: "), F.array_join(concepts, ", "))), F.when(F.size(events) > 0, F.concat(F.lit("events: "), F.array_join(events, ", "))))
    return F.concat(F.lit("Tell me about: "), F.array_join(topics, ", "), F.when(extra != "", F.concat(F.lit(" (also "), extra, F.lit(")"))).otherwise(""))


def json_list(column: str, path: str) -> Column:
    """A list of strings out of JSON text, in a fenced block or not; malformed JSON is an empty list. Objects count by their name."""
    bare = F.regexp_replace(F.col(column), r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1")
    items = F.coalesce(F.from_json(F.get_json_object(bare, path), "array<string>"), F.array().cast("array<string>"))
    return F.array_compact(F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)))


def note_json_ld(notes: DataFrame) -> DataFrame:
    """One annotation per note (note_id, target_type, target_id, body_md, created_at, deleted_at), deleted ones included."""
    body = F.struct(F.lit("TextualBody").alias("type"), F.lit("text/markdown").alias("format"), F.coalesce("body_md", F.lit("")).alias("value"))
    row = F.struct(F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.concat(F.lit("urn:note:"), F.col("note_id").cast("string")).alias("id"), F.lit("Annotation").alias("type"), body.alias("body"), F.concat(F.lit("urn:"), "target_type", F.lit(":"), F.col("target_id").cast("string")).alias("target"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), F.date_format("deleted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deleted"))
    return notes.select("note_id", F.to_json(row).alias("value"))


def note_from_json_ld(lines: DataFrame) -> DataFrame:
    """The columns of note_json_ld's lines again."""
    get = lambda p: F.get_json_object("value", p)
    target = F.regexp_extract(get("$.target"), "^urn:([^:]+):(.*)$", 1)
    at = lambda p: F.to_timestamp_ntz(get(p), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return lines.select(F.regexp_extract(get("$.id"), "urn:note:(.*)$", 1).cast("long").alias("note_id"), target.alias("target_type"), F.regexp_extract(get("$.target"), "^urn:([^:]+):(.*)$", 2).alias("target_id"), get("$.body.value").alias("body_md"), at("$.created").alias("created_at"), at("$.deleted").alias("deleted_at"))


def note_markdown(notes: DataFrame) -> DataFrame:
    """One Markdown text per target, its notes by time."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "note_id", "body_md"))), lambda n: F.concat(F.lit("- "), n["body_md"]))
    return notes.filter("deleted_at is null").groupBy("target_type", "target_id").agg(F.concat(F.lit("## "), F.first("target_type"), F.lit(" "), F.first(F.col("target_id").cast("string")), F.lit("\n"), F.array_join(lines, "\n")).alias("markdown"))


def write_archive(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """One folder of JSON lines per table, and a manifest of row counts and content hashes."""
    out = None
    for name, df in tables.items():
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{name}")
        again = df.sparkSession.read.text(f"{path}/{name}")
        one = again.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0)).alias("hash"))
        out = one if out is None else out.unionByName(one)
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return out


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert's batch."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upserted(stored: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored rows with those of the batch put in their place."""
    new = last_wins(rows, key, order)
    return stored.join(new.select(*key), key, "left_anti").unionByName(new.select(*stored.columns))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that point to the ids (one column)."""
    return {n: t.join(ids.select(F.col(ids.columns[0]).alias(k)), k, "left_anti") for n, (t, k) in tables.items()}


def first_per_key(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Key and the value of its first row, as a migration keeps."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))

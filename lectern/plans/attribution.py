"""Queries over the details of claims, and where they are said."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import details as fn
from lectern.operators import attribution
from lectern.plans.registry import Tables, query


@query("numbers_in_words", "SELECT o_orderkey, [CAST(o_orderkey AS VARCHAR)] AS said FROM orders")
def numbers_in_words(t: Tables):
    """Every key, spelled out and read again."""
    return t.orders.select("o_orderkey", fn.spelled("o_orderkey").alias("words")).select("o_orderkey", fn.spoken_numbers("words").alias("said"))


@query("unsupported_figures", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [CAST(1000 + o_orderkey AS VARCHAR)] END AS keys FROM orders")
def unsupported_figures(t: Tables):
    """Claims of a figure against a source that says it in words in a third of the rows, and another one in the others."""
    n = F.col("o_orderkey") + 1000
    said = F.when(F.col("o_orderkey") % 3 == 0, n).otherwise(n + 1)
    rows = t.orders.select("o_orderkey", F.concat(F.lit("It took "), n.cast("string"), F.lit(" steps at 10:20.")).alias("claim"), F.concat(F.lit("and that was "), fn.spelled(said), F.lit(" of them")).alias("source"))
    rows = attribution.unsupported(rows, "claim", "source")
    return rows.select("o_orderkey", F.transform("unsupported", lambda d: d["key"]).alias("keys"))


@query("detail_sources")
def detail_sources(t: Tables):
    """The details of every benchmark passage and page, and how many documents say them."""
    pages = t.pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("id"), F.regexp_replace("html", "<[^>]+>", " ").alias("text"))
    claims = t.benchmark.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("id"), "text").unionByName(pages)
    return attribution.sources_of(claims, t.documents, "id", "text", "doc_id", "text")

"""Spans that mix two languages, from tagged words: which one gives the grammar, and how a quotation of it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: At least this share of the other language's words, under its grammar, keeps its own script; at most that
#: share under English grammar is plain English.
DOMINANT, BORROWED = 0.6, 0.2


def span_analysis(tokens: DataFrame, morphemes: DataFrame, span: str, english: str = "en", other: str = "hi", unknown: str = "other") -> DataFrame:
    """span, en_tokens, hi_tokens, hi_share, matrix (en, hi or none), embedded of tagged words (span, norm, tag).

    Words that carry grammar (morphemes: tag, norm, weight) vote for the language they are tagged as; a tie goes to the
    language with more words. A span mostly in a language without a name counts as the other grammar."""
    votes = tokens.join(morphemes.select("tag", "norm", "weight"), ["tag", "norm"], "left")
    tag, weight = F.col("tag"), F.coalesce("weight", F.lit(0.0))
    of = lambda t: F.count_if(tag == t)
    sums = votes.groupBy(span).agg(of(english).alias("en_tokens"), (of(other) + of(unknown)).alias("hi_tokens"), of(unknown).alias("__u"), F.sum(F.when(tag == english, weight).otherwise(0.0)).alias("__e"), F.sum(F.when(tag == other, weight).otherwise(0.0)).alias("__h"))
    e, h = F.col("en_tokens"), F.col("hi_tokens")
    by_words = F.when(e + h == 0, "none").when(h > e, "hi").otherwise("en")
    matrix = F.when(F.col("__u") > e, "hi").when(F.col("__e") > F.col("__h"), "en").when(F.col("__h") > F.col("__e"), "hi").otherwise(by_words)
    out = sums.withColumn("matrix", matrix).withColumn("hi_share", F.when(e + h > 0, h / (e + h)).otherwise(0.0))
    embedded = F.when((F.col("matrix") == "en") & (h > 0), "hi").when((F.col("matrix") == "hi") & (e > 0), "en")
    return out.select(span, "en_tokens", "hi_tokens", "hi_share", "matrix", embedded.alias("embedded"))


def rendering_mode(share: str | Column = "hi_share", matrix: str | Column = "matrix", dominant: float = DOMINANT, borrowed: float = BORROWED) -> Column:
    """plain_english, roman or native_script: the grammar decides first, then the share of words."""
    s, m = (F.col(c) if isinstance(c, str) else c for c in (share, matrix))
    plain = (F.coalesce(s, F.lit(0.0)) <= 0) | (m == "none") | (m != "hi") & (s <= borrowed)
    return F.when(plain, "plain_english").when((m == "hi") & (s >= dominant), "native_script").otherwise("roman")


# Words of a window, and of a rest that stands alone; the least share of words that could be named.
LEAST_WORDS, MOST_WORDS, NAMED = 12, 40, 0.5


def transcript_windows(df: DataFrame, key: str, pieces: str, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """key, window, text: an array of pieces cut into windows of most words, or at the end of a piece from least words on.

    A rest of under half of least words is joined to the window before it. One fold over the pieces' lengths gives the
    places of the cuts; no shuffle."""
    words = lambda p: F.filter(F.split(F.coalesce(p, F.lit("")), r"\s+"), lambda w: w != "")
    df = df.select(key, F.transform(pieces, words).alias("__parts")).select(key, F.flatten("__parts").alias("__w"), F.transform("__parts", lambda p: F.size(p)).alias("__n"))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("done"), F.array().cast("array<int>").alias("cuts"))

    def after(state: Column, n: Column) -> Column:
        """open: words since the last cut."""
        held, base = state["open"] + n, state["done"] - state["open"]
        full = F.floor(held / most).cast("int")
        rest = held - full * most
        cuts = F.transform(F.slice(F.sequence(F.lit(0), full), 2, full), lambda k: base + k * most)
        ends = F.when(rest >= least, F.array(state["done"] + n)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.when(rest >= least, 0).otherwise(rest).alias("open"), (state["done"] + n).alias("done"), F.concat(state["cuts"], cuts, ends).alias("cuts"))

    cut = F.aggregate("__n", start, after, lambda s: s["cuts"])
    df = df.select(key, "__w", cut.alias("__cuts")).withColumn("__last", F.coalesce(F.array_max("__cuts"), F.lit(0)))
    rest = F.size("__w") - F.col("__last")
    joined = (rest * 2 < least) & (F.size("__cuts") > 0)
    ends = F.when(rest == 0, F.col("__cuts")).when(joined, F.concat(F.slice("__cuts", F.lit(1), F.size("__cuts") - 1), F.array(F.size("__w")))).otherwise(F.concat("__cuts", F.array(F.size("__w"))))
    df = df.select(key, "__w", ends.alias("__ends")).withColumn("__starts", F.concat(F.array(F.lit(0)), "__ends"))
    spans = df.select(key, "__w", F.posexplode(F.zip_with(F.slice("__starts", F.lit(1), F.size("__ends")), "__ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("window", "__s"))
    return spans.select(key, "window", F.array_join(F.slice("__w", F.col("__s.a") + 1, F.col("__s.b") - F.col("__s.a")), " ").alias("text"))


def transcript_profile(windows: DataFrame, key: str, window: str, borrowed: float = BORROWED, dominant: float = DOMINANT) -> DataFrame:
    """What a source is mainly spoken in, of its windows (en_tokens, hi_tokens, other_tokens, matrix, mode, native: the script of its
    other words).

    matrix_hi_share weighs each window's grammar by its words; a Latin source whose other words mostly have no name, and are
    more than borrowing explains, is in another language. flicker counts changes of script between windows that have one."""
    scripted = F.when(F.col("mode") != "plain_english", F.col("mode"))
    order = Window.partitionBy(key).orderBy(window)
    before = F.last(scripted, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = windows.withColumn("__change", (scripted.isNotNull() & before.isNotNull() & (scripted != before)).cast("long"))
    n = F.col("en_tokens") + F.col("hi_tokens")
    framed = lambda m: F.coalesce(F.sum(F.when(F.col("matrix") == m, n)), F.lit(0))
    modes = [F.count_if(F.col("mode") == m).alias(f"{m}_windows") for m in ("plain_english", "roman", "native_script")]
    sums = rows.groupBy(key).agg(F.sum("en_tokens").alias("__e"), F.sum("hi_tokens").alias("__h"), F.sum("other_tokens").alias("__o"), framed("hi").alias("__fh"), framed("en").alias("__fe"), F.count("*").alias("windows"), F.sum("__change").alias("flicker"), *modes)
    # The script of most words, by windows; ties go to the first by name.
    scripts = windows.filter("native is not null and hi_tokens > 0").groupBy(key, "native").agg(F.sum("hi_tokens").alias("n"))
    scripts = scripts.groupBy(key).agg(F.min_by("native", F.struct(-F.col("n"), F.col("native"))).alias("native_script"))
    e, h, o = (F.col(c) for c in ("__e", "__h", "__o"))
    out = sums.join(scripts, key, "left")
    out = out.withColumn("matrix_hi_share", F.when(F.col("__fh") + F.col("__fe") > 0, F.round(F.col("__fh") / (F.col("__fh") + F.col("__fe")), 4)).otherwise(0.0))
    out = out.withColumn("named_share", F.when(h > 0, F.round((h - o) / h, 4))).withColumn("hi_share", F.when(e + h > 0, F.round(h / (e + h), 4)).otherwise(0.0))
    unnamed = (F.col("native_script") == "Latin") & (F.col("named_share") < NAMED) & (h / (e + h) > borrowed)
    known = F.col("native_script").isin("Devanagari", "Arabic", "Latin")
    primary = F.when(e + h == 0, "none").when(unnamed, "other").when(F.col("matrix_hi_share") < 0.5, "en").when(known, "hi").otherwise("other")
    out = out.withColumn("primary_language", primary)
    matrix = F.when(F.col("primary_language").isin("hi", "other"), "hi").otherwise(F.col("primary_language"))
    out = out.withColumn("quote_mode", rendering_mode(F.col("hi_share"), matrix, dominant, borrowed))
    return out.select(key, "primary_language", "native_script", "hi_share", "named_share", "matrix_hi_share", "quote_mode", "windows", "plain_english_windows", "roman_windows", "native_script_windows", "flicker")


def resolved_mode(span_mode: str | Column, quote_mode: str | Column) -> Column:
    """A span that is plain English stays so; of others the source decides the script."""
    s, q = (F.col(c) if isinstance(c, str) else c for c in (span_mode, quote_mode))
    return F.when(s == "plain_english", s).when(q == "native_script", q).otherwise("roman")

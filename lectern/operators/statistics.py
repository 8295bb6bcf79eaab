"""Aggregations: corpus, channel and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from lectern.functions.text import beyond_ascii
from lectern.operators.stored import checkpoints


def first_nonzero(*columns: str) -> Column:
    """The first value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns], F.lit(0))


def upper_median(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The element at n div 2 of the sorted known values, per group.

    Ranked by distinct value, so that a group's rows never meet in one list."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy(column)
    ranked = counts.withColumn("__upto", F.sum("__n").over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    return ranked.filter(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*by).agg(F.min(column).alias("median"))


def corpus_statistics(docs: DataFrame, by: list[str], words: Column, date: str) -> DataFrame:
    """Documents, words, earliest, latest and dated count per group, with the upper median of the dates."""
    base = docs.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(words).alias("words"), F.min(date).alias("earliest"), F.max(date).alias("latest"), F.count(date).alias("dated"))
    return base.join(upper_median(docs, date, by), by, "left")


def counts_by_year(docs: DataFrame, date: str) -> DataFrame:
    return docs.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("documents"))


def era_summary(df: DataFrame, by: list[str], start: str, end: str, confidence: str, retrospective: str) -> DataFrame:
    """Known rows have a start and some confidence; an open end is the start."""
    known = F.col(start).isNotNull() & (F.coalesce(F.col(confidence), F.lit(0.0)) > 0)
    last = F.greatest(F.coalesce(end, start), F.col(start))
    return df.groupBy(*by).agg(F.count_if(known).alias("known"), F.min(F.when(known, F.col(start))).alias("earliest"), F.max(F.when(known, last)).alias("latest"), F.count_if(known & F.coalesce(F.col(retrospective), F.lit(False))).alias("retrospective"))


def channel_report(chunks: DataFrame, channel: str, video: str, words: str, end: str) -> DataFrame:
    """Per channel: videos, words once per video, minutes as the rounded sum of each video's last second."""
    videos = chunks.groupBy(channel, video).agg(F.max(words).alias("w"), F.max(end).alias("e"))
    return videos.groupBy(channel).agg(F.count("*").alias("videos"), F.sum("w").alias("words"), F.bround(F.sum("e") / 60).cast("long").alias("minutes"))


def monthly_cadence(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    """Count per month from a group's first to its last, months without a row included."""
    month = F.trunc(F.col(date).cast("date"), "month")
    counts = df.filter(F.col(date).isNotNull()).groupBy(*by, month.alias("month")).agg(F.count("*").alias("n"))
    spans = counts.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = spans.select(*by, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return every.join(counts, [*by, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def undated(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    """by, undated: the rows that no month counts."""
    return df.groupBy(*by).agg(F.count_if(F.col(date).isNull()).alias("undated"))


#: Bounds of the duration buckets in minutes: [low, high).
BUCKETS = ((0, 5), (5, 15), (15, 30), (30, 60), (60, 120), (120, None))


def duration_bucket(seconds: str) -> Column:
    """The bucket's name; unknown where there is no duration."""
    out = F.lit("unknown")
    for low, high in reversed(BUCKETS):
        name = f"{low}-{high}" if high else f"{low}+"
        out = F.when((F.col(seconds) >= low * 60) & (F.lit(True) if high is None else F.col(seconds) < high * 60), name).otherwise(out)
    return out


#: Labels to look for that are sent to every task; more are joined.
SENT = 1 << 18


def label_counts(labels: DataFrame, doc: str, label: str, by: list[str], top: int = 25, examples: int = 8) -> DataFrame:
    """Labels (one a row, or an array of them) folded by case, counted once per document; shown in the most frequent spelling.

    A document's labels are one array, gathered only where it has several rows. Each array adds its labels, and its distinct
    folded ones once more, so that one count by label gives spellings and documents, and no label moves for each document."""
    spark = labels.sparkSession
    checkpoints(spark)
    several = isinstance(labels.schema[label].dataType, ArrayType)
    rows = labels.select(*by, F.col(doc).alias("doc"), F.col(label) if several else F.array(label).alias(label))
    if not rows.groupBy(*by, "doc").count().filter("count > 1").isEmpty():
        rows = rows.groupBy(*by, "doc").agg(F.flatten(F.collect_list(label)).alias(label))
    # Most arrays hold no white space at all, which is seen at once.
    clean = F.transform(label, lambda w: F.regexp_replace(F.trim(w), r"\s+", " "))
    clean = F.when(F.rlike(F.array_join(label, ""), F.lit(r"\s")), clean).otherwise(F.col(label))
    rows = rows.select(*by, "doc", clean.alias("labels")).withColumn("labels", F.filter("labels", lambda w: w != ""))
    rows = rows.withColumn("keys", F.array_distinct(F.transform("labels", F.lower)))
    # Keys first: what stands before their number counts a document, all else a spelling. (Without outer, arrays are made
    # once more beforehand, to see whether they are empty.)
    every = rows.select(*by, "doc", F.size("keys").alias("size"), F.posexplode_outer(F.concat("keys", "labels")).alias("place", "label")).filter("label is not null")
    is_key = F.col("place") < F.col("size")
    counts = every.groupBy(*by, "label").agg(F.count_if(~is_key).alias("n"), F.count_if(is_key & F.col("doc").isNotNull()).alias("documents"))
    capitals = F.length(F.regexp_replace("label", "[^A-Z]", ""))
    spelling = F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), (-capitals).alias("c"), "label"))
    docs = counts.groupBy(*by, F.lower("label").alias("key")).agg(F.sum("documents").alias("documents"), F.min(spelling).alias("s"))
    order = Window.partitionBy(*by).orderBy(F.desc("documents"), "key")
    best = docs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).checkpoint()
    # Only the labels shown need examples: the first few documents of each.
    wanted = best.select(*by, "key")
    wanted = F.broadcast(wanted) if best.count() <= SENT else wanted
    nth = Window.partitionBy(*by, "key").orderBy("doc")
    shown = rows.select(*by, "doc", F.explode_outer("keys").alias("key")).join(wanted, [*by, "key"], "left_semi")
    shown = shown.withColumn("r", F.row_number().over(nth)).filter(F.col("r") <= examples)
    shown = shown.groupBy(*by, "key").agg(F.array_sort(F.collect_list("doc")).alias("examples"))
    return best.join(shown, [*by, "key"]).select(*by, "rank", "key", F.col("s.label").alias("label"), "documents", "examples")


def tfidf_terms(docs: DataFrame, doc: str, text: str, newest: Column | None = None, documents: int = 500, characters: int = 40_000, stop: tuple[str, ...] = (), least_df: int = 2, features: int = 20_000, top: int = 60) -> DataFrame:
    """Terms by summed tf-idf weight: 1 + ln(tf), ln((1 + n) / (1 + df)) + 1, rows of unit length.

    The newest documents and the leading characters are the operator's feature, as is the number of terms."""
    if newest is not None:
        docs = docs.orderBy(newest, F.desc(doc)).limit(documents)
    words = F.regexp_extract_all(F.lower(F.left(text, F.lit(characters))), F.lit(r"[\p{L}]{3,}"), F.lit(0))
    tf = docs.select(F.col(doc).alias("doc"), F.explode(words).alias("term")).filter(~F.col("term").isin(list(stop)) if stop else F.lit(True)).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    n = docs.agg(F.count("*").alias("n"))
    kept = df.join(F.broadcast(n)).filter(F.col("df") >= F.when(F.col("n") >= 5, least_df).otherwise(1)).orderBy(F.desc("all"), "term").limit(features)
    weighted = tf.join(kept, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sums = weighted.join(norms, "doc").groupBy("term").agg(F.sum(F.col("w") / F.col("norm")).alias("weight"), F.max("df").alias("df"))
    best = sums.orderBy(F.desc("weight"), "term").limit(top)
    peak = best.agg(F.max("weight").alias("peak"))
    return best.join(F.broadcast(peak)).select("term", "df", (F.col("weight") / F.col("peak")).alias("weight"))


def usage_summary(usage: DataFrame, day: str, today, feature: str, metric: str, amount: str, days: int = 30) -> DataFrame:
    """Sums of today and of the last days, by feature and metric."""
    recent = usage.filter((F.col(day) <= F.lit(today).cast("date")) & (F.col(day) > F.date_sub(F.lit(today).cast("date"), days)))
    return recent.groupBy(feature, metric).agg(F.sum(F.when(F.col(day) == F.lit(today).cast("date"), F.col(amount)).otherwise(0.0)).alias("today"), F.sum(amount).alias("last_days"))


def period_quota(usage: DataFrame, user: str, at: str, period: str, limit: int) -> DataFrame:
    """Consumed per user and period against a limit (-1: none), and when the next period starts."""
    start = F.date_trunc(period, F.col(at).cast("timestamp_ntz")).cast("timestamp_ntz")
    out = usage.groupBy(F.col(user).alias("user"), start.alias("period_start")).agg(F.count("*").alias("consumed"))
    step = {"day": "1 DAY", "month": "1 MONTH"}[period]
    blocked = F.lit(False) if limit < 0 else F.col("consumed") >= limit
    return out.withColumn("blocked", blocked).withColumn("retry_at", F.when(blocked, F.col("period_start") + F.expr(f"INTERVAL {step}")))


def daily_best_total(df: DataFrame, day: Column, source: str, value: str) -> DataFrame:
    """Per day the largest of the sources' sums: two devices never add up."""
    return df.groupBy(day.alias("day"), source).agg(F.sum(value).alias("total")).groupBy("day").agg(F.max("total").alias("total"))


def gate(criteria: list[tuple[str, Column, float]]) -> list[Column]:
    """Columns of a readiness gate: each criterion's fraction of its target in [0, 1], their mean, and whether all are met."""
    fractions = [F.least(F.greatest(c / F.lit(float(t)), F.lit(0.0)), F.lit(1.0)) for _, c, t in criteria]
    mean = sum(fractions[1:], fractions[0]) / len(fractions)
    met = fractions[0] >= 1
    for f in fractions[1:]:
        met = met & (f >= 1)
    return [f.alias(n) for f, (n, _, _) in zip(fractions, criteria)] + [mean.alias("readiness"), met.alias("ready")]


def precision_recall(df: DataFrame, gold: str, found: str, neutral: Column | None = None) -> DataFrame:
    """Precision, recall and F1 over scored rows (neutral gold is not scored)."""
    rows = df if neutral is None else df.filter(~neutral)
    tp, fp, fn = (F.count_if((F.col(found) == f) & (F.col(gold) == g)) for f, g in ((1, 1), (1, 0), (0, 1)))
    c = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def unit_scores(tokens: DataFrame, unit: str, gold: str, found: str, label: str, neutral: Column | None = None) -> DataFrame:
    """unit_precision, unit_recall, share_mae, agreement over units of tagged words.

    A unit holds a label if any scored word of it does; share_mae is the mean difference between the label's gold and found
    shares of a unit's words; agreement is the share of words tagged alike. Words with neutral gold are not scored."""
    rows = tokens if neutral is None else tokens.filter(~neutral)
    g, f = F.col(gold) == label, F.col(found) == label
    units = rows.groupBy(unit).agg(F.bool_or(g).alias("g"), F.bool_or(f).alias("f"), F.avg(g.cast("int")).alias("a"), F.avg(f.cast("int")).alias("b"), F.count_if(F.col(gold) == F.col(found)).alias("same"), F.count("*").alias("n"))
    both = F.count_if(F.col("g") & F.col("f"))
    return units.agg((both / F.nullif(F.count_if("f"), F.lit(0))).alias("unit_precision"), (both / F.nullif(F.count_if("g"), F.lit(0))).alias("unit_recall"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("share_mae"), (F.sum("same") / F.sum("n")).alias("agreement"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("worst"), F.count("*").alias("n"))


def starved_groups(chunks: DataFrame, items: DataFrame, key: str, least: int = 10, share: float = 0.2) -> DataFrame:
    """Groups with many chunks but few items."""
    c = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    i = items.groupBy(key).agg(F.count("*").alias("items"))
    out = c.join(i, key, "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    return out.filter((F.col("chunks") >= least) & (F.col("items") / F.col("chunks") < share))


def structural_union(items: DataFrame, identity: list[str], order: str, modality: str) -> DataFrame:
    """The first of equal items stays, with all their modalities and how many there were."""
    first = Window.partitionBy(*identity).orderBy(order)
    seen = items.groupBy(*identity).agg(F.array_sort(F.collect_set(modality)).alias("modalities"), F.count("*").alias("copies"))
    return items.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r", modality).join(seen, identity)


def merge_signals(signals: DataFrame, key: list[str], source: str, status: str) -> DataFrame:
    """Weight of a signal: its distinct sources. Rejected ones keep nothing, deleted ones come back."""
    out = signals.groupBy(*key).agg(F.countDistinct(source).alias("weight"), F.bool_or(F.col(status) == "rejected").alias("rejected"), F.bool_or(F.col(status) == "source_deleted").alias("was_deleted"))
    return out.filter(~F.col("rejected")).select(*key, "weight", F.when(F.col("was_deleted"), "revived").otherwise("active").alias("state"))


def style_profile(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """Long-form counts of words and letter trigrams: partial sums that merge by addition."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = texts.select(*by, F.explode(F.regexp_extract_all(low, F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    # Every distinct word is cut into trigrams once, and they count as often as it does.
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    grams = F.transform(F.regexp_extract_all("word", F.lit("(?=(...))."), F.lit(1)), lambda g: key("trigram", g))
    long = words.select(*by, F.explode(F.concat(F.array(key("word", F.col("word"))), grams)).alias("x"), "n")
    return long.select(*by, "x.kind", "x.key", "n").groupBy(*by, "kind", "key").agg(F.sum("n").alias("n"))


def style_similarity(profile: DataFrame, by: str, other) -> DataFrame:
    """0.5 cosine over words + 0.5 cosine over trigrams of every group against one, rounded to 4 places."""
    one = profile.filter(F.col(by) == other).select("kind", "key", F.col("n").alias("m"))
    dot = profile.join(one, ["kind", "key"]).groupBy(by, "kind").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    norm = profile.groupBy(by, "kind").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    size = one.groupBy("kind").agg(F.sqrt(F.sum(F.col("m") * F.col("m")).cast("double")).alias("size"))
    cos = norm.join(dot, [by, "kind"], "left").join(F.broadcast(size), "kind").withColumn("c", F.coalesce(F.col("dot") / (F.col("norm") * F.col("size")), F.lit(0.0)))
    return cos.groupBy(by).agg(F.bround(F.sum(F.col("c") * 0.5), 4).alias("similarity"))


#: The scripts a profile tells apart.
_SCRIPT_NAMES = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Gujarati", "Gurmukhi", "Tamil", "Telugu", "Kannada", "Malayalam", "Thai", "Han", "Hiragana", "Katakana", "Hangul")
SCRIPTS = {name.lower(): rf"\p{{Is{name}}}" for name in _SCRIPT_NAMES}


def script_shares(text: str) -> list[Column]:
    """Share of each script among a text's letters of known scripts."""
    every, rest = F.coalesce(F.col(text), F.lit("")), beyond_ascii(text)
    counts = {k: F.regexp_count(rest, F.lit(f"[{p}]")) for k, p in SCRIPTS.items()}
    # Of ASCII only the letters are of a script.
    counts["latin"] = counts["latin"] + F.length(every) - F.length(F.regexp_replace(every, "[A-Za-z]+", ""))
    total = sum(list(counts.values())[1:], list(counts.values())[0])
    return [(c / F.nullif(total, F.lit(0))).alias(k) for k, c in counts.items()]


def share_of_total(df: DataFrame, value: str, places: int = 1) -> Column:
    """Percent of the sum over all rows, which is one number."""
    total = df.agg(F.sum(value)).first()[0]
    return F.bround(100 * F.col(value) / F.lit(total), places)


def capped_confidence(n: str) -> Column:
    return F.round(F.least(F.lit(0.8), 0.4 + 0.1 * (F.col(n) - 1)), 2)


def cost_estimate(calls: Column, tokens: Column, price: Column) -> Column:
    """calls * tokens * price per million; null where there is no price."""
    return calls * tokens * price / 1_000_000

"""A tenant's library: grouped search, listings with a total, inputs of several kinds, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import firsts, in_order
from lectern.operators.filters import in_scope, like_any, visible
from lectern.operators.retrieval import bm25

#: The kinds of a grouped search, in the order of their groups.
SEARCH_TYPES = ("documents", "knowledge", "jobs", "channels", "qa")
#: So many times the rows asked for are fetched before rows of one id are made one.
OVERFETCH = 4


def channels_of(tenant, subscriptions: DataFrame, grants: DataFrame, documents: DataFrame) -> DataFrame:
    """Channels a tenant may see: those subscribed to (channel_id, tenant_id) and those of a visible document (document_id, channel_id)."""
    subscribed = subscriptions.filter(F.col("tenant_id") == tenant).select("channel_id")
    published = visible(documents, grants, tenant).filter("channel_id is not null").select("channel_id")
    return subscribed.union(published).distinct()


def grouped_search(q: str, tables: dict[str, DataFrame], types: tuple[str, ...] = SEARCH_TYPES, limit: int = 5) -> DataFrame:
    """type, place, id, title, score over tables (id, title, text, created_at) that hold what the tenant may see.

    Ranked by BM25 where a term has three letters or more, else by recency with the score 0; rows of one id count once, at
    their best. A blank question has empty groups; unknown types are an error."""
    words = q.split()
    out = None
    for kind in [t for t in SEARCH_TYPES if t in types]:
        rows = tables[kind].select("id", "title", "text", "created_at")
        n = limit * OVERFETCH
        if any(len(w) >= 3 for w in words):
            ranked = bm25(rows, words, "id", {"title": 5.0, "text": 1.0}, "created_at", k=n).join(rows.groupBy("id").agg(F.max("created_at").alias("created_at"), F.min("title").alias("title")), "id")
        else:
            found = rows.filter(like_any(" ".join(words), "title", "text")) if words else rows.filter(F.lit(False))
            ranked = found.withColumn("score", F.lit(0.0)).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
        best = ranked.groupBy("id").agg(F.max("score").alias("score"), F.max("created_at").alias("created_at"), F.min("title").alias("title"))
        # At most n rows.
        order = Window.partitionBy("type").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
        one = best.withColumn("type", F.lit(kind)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        one = one.select("type", "place", F.col("id").cast("string").alias("id"), "title", "score")
        out = one if out is None else out.unionByName(one)
    if out is None or set(types) - set(SEARCH_TYPES):
        raise ValueError(f"search types are {SEARCH_TYPES}")
    return out


def library_rows(docs: DataFrame, grants: DataFrame, tenant, job_ids: list | None = None, jobs: DataFrame | None = None, search: str | None = None, tags: DataFrame | None = None, tag=None, **equal) -> DataFrame:
    """Visible documents under all filters given: of runs (jobs: document_id, job_id; an empty list is nothing), words in title
    or channel, equal columns (language, channel_id, transcript_status, document_id), and a tag of this tenant
    (tags: document_id, tenant_id, tag_id)."""
    out = visible(docs, grants, tenant)
    if job_ids is not None:
        out = in_scope(out, "document_id", jobs.filter(F.col("job_id").isin(job_ids)).select("document_id") if job_ids else [])
    if search:
        out = out.filter(like_any(search, "title", "channel_name"))
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    if tag is not None:
        out = in_scope(out, "document_id", tags.filter((F.col("tag_id") == tag) & (F.col("tenant_id") == tenant)).select("document_id"))
    return out


def listed(rows: DataFrame, search: str | None, columns: tuple[str, ...], newest: str, oldest: str, id_col: str, of_one_import: bool = False, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """(page, total): newest first, or oldest first for the rows of one import; words match any of the columns."""
    found = rows.filter(like_any(search, *columns)) if search else rows
    order = [F.asc(oldest), F.asc(id_col)] if of_one_import else [F.desc(newest), F.desc(id_col)]
    return found.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0)), found.count()


def both(*conditions: Column | None) -> Column:
    """All conditions that are given; none is everything."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def informative(frames: DataFrame) -> DataFrame:
    """Frames (status, informative, text) that were described, say something and have a text."""
    return frames.filter((F.col("status") == "described") & F.col("informative") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def approved(rows: DataFrame, job: str, flag: str, jobs: list | None = None) -> DataFrame:
    """The approved rows of jobs, or of all."""
    return in_scope(rows.filter(F.coalesce(F.col(flag), F.lit(False))), job, jobs)


def cited_activity(exchanges: DataFrame, refs: DataFrame, docs: DataFrame, top: int = 10, recent: int = 10) -> DataFrame:
    """kind, id, n, place: how many exchanges (id, at) cite one of docs (doc), by refs (id, doc); the most cited of docs; the newest of the exchanges."""
    hits = refs.select("id", "doc").distinct().join(docs.select("doc").distinct(), "doc", "left_semi").join(exchanges.select("id", "at"), "id")
    citing = hits.select("id", "at").distinct()
    none = F.lit(None)
    every = citing.agg(F.count("*").alias("n")).select(F.lit("exchanges").alias("kind"), none.cast("string").alias("id"), "n", F.lit(1).alias("place"))
    w = Window.partitionBy("kind")
    cited = hits.groupBy("doc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc").limit(top)
    cited = cited.withColumn("kind", F.lit("cited")).select("kind", F.col("doc").cast("string").alias("id"), "n", F.row_number().over(w.orderBy(F.desc("n"), "doc")).alias("place"))
    newest = citing.orderBy(F.desc_nulls_last("at"), "id").limit(recent)
    newest = newest.withColumn("kind", F.lit("recent")).select("kind", F.col("id").cast("string").alias("id"), none.cast("long").alias("n"), F.row_number().over(w.orderBy(F.desc_nulls_last("at"), "id")).alias("place"))
    return every.unionByName(cited).unionByName(newest)


def first_of_each(df: DataFrame, by: list[str], items: str) -> DataFrame:
    """by, items: each list without blanks and without what it had before in other case; the first spelling stays."""
    placed = F.filter(F.transform(items, lambda x, i: F.struct(F.lower(F.trim(x)).alias("k"), i.alias("i"), F.trim(x).alias("x"))), lambda y: y["x"] != "")
    # What a list repeats goes before anything moves; what lists of one group repeat of each other, after.
    once = F.sort_array(F.transform(firsts(placed), lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    lists = df.select(*by, once.alias("__f")).filter(F.size("__f") > 0).groupBy(*by).agg(F.collect_list("__f").alias("__f"))
    keyed = F.transform(F.flatten("__f"), lambda y: F.struct(F.lower(y["x"]).alias("k"), y["i"].alias("i"), y["x"].alias("x")))
    single = F.transform(F.get("__f", 0), lambda y: y["x"])
    return lists.select(*by, F.when(F.size("__f") == 1, single).otherwise(in_order(firsts(keyed))).alias(items))


def input_fingerprint(df: DataFrame, by: list[str], id_col: str, *columns: str, version: int = 1) -> DataFrame:
    """by, fingerprint: sha256 of a version and of each row's fields in the order of ids; changes with any input of a derived table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.struct(F.col(id_col).alias("id"), F.concat(F.concat_ws("|", text(id_col), *[text(c) for c in columns]), F.lit("\n")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "")
    return df.groupBy(*by).agg(F.sha2(F.concat(F.lit(f"payload-v{version}|"), lines).cast("binary"), 256).alias("fingerprint"))


def stale(cache: DataFrame, current: DataFrame, key: str, now: Column, most_hours: int) -> DataFrame:
    """key, why of what must be computed again: missing, changed (another fingerprint) or expired."""
    old = cache.select(key, F.col("fingerprint").alias("__old"), "computed_at")
    rows = current.join(old, key, "left")
    late = F.col("computed_at") < now - F.expr(f"INTERVAL {most_hours} HOURS")
    why = F.when(F.col("__old").isNull(), "missing").when(F.col("__old") != F.col("fingerprint"), "changed").when(late, "expired")
    return rows.select(key, why.alias("why")).filter("why is not null")


def change_verdicts(runs: DataFrame, before: str, after: str, distance: str, least: float = 0.5, most: float = 0.15) -> DataFrame:
    """runs with jaccard, changed and decided_by: the cited documents vote (before and after: arrays, null where they can't be
    compared) and so does the answers' distance (null for a first run); where both agree that is it, without the first vote the
    second decides alone, and where they differ a judge is needed: till then the cited documents decide."""
    both_empty = (F.size(before) == 0) & (F.size(after) == 0)
    j = F.when(both_empty, 1.0).otherwise(F.size(F.array_intersect(before, after)) / F.size(F.array_union(before, after)))
    j = F.when(F.col(before).isNotNull() & F.col(after).isNotNull(), j)
    by_cited, by_answer = F.coalesce(j < least, F.lit(False)), F.col(distance) > most
    decided = F.when(F.col(distance).isNull(), "none").when(by_cited == by_answer, F.when(j.isNull(), "embedding_only").otherwise("agreed")).otherwise("needs_judge")
    changed = F.when(F.col(distance).isNotNull(), by_cited)
    return runs.withColumn("jaccard", F.round(j, 4)).withColumn("changed", changed).withColumn("decided_by", decided)


def not_deleted(facts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Facts (kind, key) without those a reader once deleted: they stay deleted when an export is read again."""
    return facts.join(tombstones.select("kind", "key").distinct(), ["kind", "key"], "left_anti")


def exemplars(df: DataFrame, by: list[str], language: str, target: str, merit: str, id_col: str, k: int = 5) -> DataFrame:
    """k rows of each group, spread evenly over the range of a merit, in the target language where it has k, else in any."""
    from lectern.operators.ordering import even_picks

    enough = F.count_if(F.col(language) == target).over(Window.partitionBy(*by)) >= k
    pool = df.withColumn("__enough", enough).filter(~F.col("__enough") | (F.col(language) == target)).drop("__enough")
    return even_picks(pool, by, [F.asc(merit), F.asc(id_col)], k)


# Sizes of corpora (name, videos, words), the depth each is written in, and what a reader may ask for instead.
BRACKETS = (("xlarge", 120, 500_000), ("large", 40, 150_000), ("medium", 10, 30_000), ("small", 0, 0))
BRACKET_SCALE = {"small": 1.25, "medium": 1.1, "large": 1.0, "xlarge": 1.0}
ASKED_SCALE = {"brief": 0.45, "standard": 1.0, "deep": 1.6}


def corpus_bracket(videos: Column, words: Column) -> Column:
    """The largest size that either number reaches; small where nothing is known."""
    known = lambda c: F.coalesce(c, F.lit(0))
    return F.coalesce(*[F.when((known(videos) >= v) | (known(words) >= w), name) for name, v, w in BRACKETS])


def output_scale(bracket: Column, asked: Column) -> Column:
    pick = lambda c, table: F.coalesce(*[F.when(c == name, scale) for name, scale in table.items()])
    return F.coalesce(pick(F.lower(asked), ASKED_SCALE), pick(bracket, BRACKET_SCALE))


# The least text that says something of a writer's cadence, and the share of sentences that makes a habit.
LEAST_SENTENCES, LEAST_WORDS = 20, 300
HABITS = {"question": 0.15, "exclamation": 0.10, "ellipsis": 0.08, "dash": 0.12, "parenthesis": 0.10, "emoji": 0.08}


def cadence(sentences: str, words: str, lowercase: str, habits: dict[str, str] | None = None) -> Column:
    """Habits of a writer by columns of counts: the length of sentences first, then each habit whose share is high enough."""
    n = F.col(sentences)
    mean = F.col(words) / n
    named = [F.when(mean < 12, "short").when(mean <= 20, "medium").otherwise("long")]
    named += [F.when(F.col(column) / n >= HABITS[habit], habit) for habit, column in (habits or {h: h for h in HABITS}).items()]
    named.append(F.when(F.col(lowercase) / n >= 0.5, "lowercase"))
    return F.when((n >= LEAST_SENTENCES) & (F.col(words) >= LEAST_WORDS), F.array_compact(F.array(*named))).otherwise(F.array().cast("array<string>"))


def writer_inputs(singles: dict[str, DataFrame], grouped: dict[str, tuple[DataFrame, str]], produced: DataFrame) -> DataFrame:
    """kind, ref, at, n of all that says something of a writer, by time: single rows (ref, at) less what a saved search
    produced (ref), and rows (at) grouped by import or connector."""
    out = None
    for kind, rows in singles.items():
        one = rows.join(produced.select("ref").distinct(), "ref", "left_anti").select(F.lit(kind).alias("kind"), F.col("ref").cast("string").alias("ref"), "at", F.lit(1).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    for kind, (rows, group) in grouped.items():
        one = rows.groupBy(group).agg(F.max("at").alias("at"), F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(group).cast("string").alias("ref"), "at", "n")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("at", "ref")


#: Transcript formats in order of preference; what holds none of them is not taken.
FORMATS = ("srt", "vtt")


def best_format(rows: DataFrame, by: list[str], kind: str, *ties: str) -> DataFrame:
    """Of each group the row whose format is preferred; none where no format is one of FORMATS."""
    rank = F.coalesce(*[F.when(F.contains(F.lower(kind), F.lit(f)), i) for i, f in enumerate(FORMATS)], F.lit(99))
    w = Window.partitionBy(*by).orderBy("__rank", *ties)
    return rows.withColumn("__rank", rank).filter("__rank < 99").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__rank", "__r")


def forms_of_sources(profiles: DataFrame, source: str, order: list[str], form: str, other: str = "English") -> DataFrame:
    """form, sources: the first profile of each source, counted by form."""
    first = profiles.groupBy(source).agg(F.min(F.struct(*order, F.col(form).alias("__form"))).alias("__f"))
    return first.groupBy(F.coalesce("__f.__form", F.lit(other)).alias("form")).agg(F.count("*").alias("sources"))


def backfill_report(stored: DataFrame, computed: DataFrame, key: str, profile: str, origin: str) -> DataFrame:
    """considered, no_text, profiled, changed, unchanged, and by_origin (origin:n, sorted) of profiles computed for stored rows."""
    rows = stored.select(key, F.col(profile).alias("__old")).join(computed.select(key, F.col(profile).alias("__new"), origin), key, "left")
    made = F.col("__new").isNotNull()
    same = made & F.col("__new").eqNullSafe(F.col("__old"))
    counts = rows.agg(F.count("*").alias("considered"), F.count_if(~made).alias("no_text"), F.count_if(made).alias("profiled"), F.count_if(made & ~same).alias("changed"), F.count_if(same).alias("unchanged"))
    origins = rows.filter(made).groupBy(origin).agg(F.count("*").alias("n"))
    named = origins.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", origin, "n"))), ",")).first()[0]
    return counts.withColumn("by_origin", F.lit(named))


def evidence(rows: DataFrame, source: str, kind: str, at: str, text: str) -> DataFrame:
    """source, and per kind (speech, span) its texts by time."""
    item = F.struct(F.col(at).alias("at"), F.col(text).alias("text"))
    one = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, item))), lambda x: x["text"])
    return rows.groupBy(source).agg(one("speech").alias("speech"), one("span").alias("spans"))


def merged_collections(new: DataFrame, legacy: DataFrame, video: str, index: str) -> DataFrame:
    """Rows of both collections, once for each (video, index): the newer one's where both have it."""
    lacking = legacy.join(new.select(video, index), [video, index], "left_anti").dropDuplicates([video, index])
    return new.dropDuplicates([video, index]).unionByName(lacking.select(*new.columns))


def synced_uploads(uploads: DataFrame, linked: DataFrame, by: list[str], item: str, order: list[Column], room: int) -> DataFrame:
    """Uploads that are not linked yet, oldest request first, as far as a tenant's room goes; what it sees already (held) passes."""
    from lectern.operators.ordering import quota_admission

    fresh = uploads.join(linked.select(item).distinct(), item, "left_anti")
    return quota_admission(fresh, by, F.col("held"), order, room).filter("admitted").drop("admitted")


def health_nights(segments: DataFrame, source: str, start: str, end: str, gap_minutes: float, night_minutes: float) -> DataFrame:
    """day, source, minutes, onset, wake: sessions of sleep (segments within the gap are one, overlap counts once) that are long
    enough, one for each day of waking: the source that slept most."""
    w = Window.partitionBy(source).orderBy(start, end)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 60e6
    rows = segments.select(source, start, end, micros(start).alias("__a"), micros(end).alias("__b"))
    rows = rows.withColumn("__reached", F.max("__b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__new", F.when(F.col("__a") - F.col("__reached") <= gap_minutes, 0).otherwise(1)).withColumn("__s", F.sum("__new").over(w))
    slept = F.greatest(F.lit(0.0), F.col("__b") - F.when(F.col("__new") == 1, F.col("__a")).otherwise(F.greatest("__a", "__reached")))
    nights = rows.groupBy(source, "__s").agg(F.sum(slept).alias("minutes"), F.min(start).alias("onset"), F.max(end).alias("wake")).filter(F.col("minutes") >= night_minutes)
    best = nights.groupBy(F.to_date("wake").alias("day")).agg(F.max_by(F.struct(source, "minutes", "onset", "wake"), F.struct("minutes", source)).alias("n"))
    return best.select("day", "n.*")


def clock_from_noon(minutes: Column) -> Column:
    """hh:mm of minutes since noon."""
    whole = F.pmod(F.round(minutes).cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", F.pmod(F.floor(whole / 60) + 12, F.lit(24)).cast("int"), F.pmod(whole, F.lit(60)))


def sleep_facts(nights: DataFrame) -> DataFrame:
    """nights, median_hours_asleep, typical_bedtime, typical_wake_time: clock times by their median since noon, so that either side of midnight sorts."""
    noon = lambda c: F.pmod(F.hour(c) - 12, F.lit(24)) * 60 + F.minute(c)
    m = nights.agg(F.count("*").alias("nights"), F.round(F.median("minutes") / 60, 1).alias("median_hours_asleep"), F.median(noon("onset")).alias("__o"), F.median(noon("wake")).alias("__w"))
    return m.select("nights", "median_hours_asleep", clock_from_noon(F.col("__o")).alias("typical_bedtime"), clock_from_noon(F.col("__w")).alias("typical_wake_time"))


def step_facts(days: DataFrame, steps: str) -> DataFrame:
    """days, median_daily_steps, mean_daily_steps (rounded down)."""
    return days.agg(F.count("*").alias("days"), F.floor(F.median(steps)).alias("median_daily_steps"), F.floor(F.avg(steps)).alias("mean_daily_steps"))


def workout_facts(workouts: DataFrame, day: str, kind: str, minutes: str) -> DataFrame:
    """kind, workouts, per_week (over the days that the data cover, a week at least), median_minutes."""
    span = workouts.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.greatest(F.lit(1.0), (F.date_diff("b", "a") + 1) / 7).alias("weeks")).first()
    weeks = F.lit(span["weeks"] or 1.0)
    return workouts.groupBy(kind).agg(F.count("*").alias("workouts"), F.round(F.count("*") / weeks, 2).alias("per_week"), F.bround(F.median(minutes)).alias("median_minutes"))


def usage_ranking(rows: DataFrame, feature: str, metric: str, amount: str, day: str, today: Column, days: int, features: tuple[str, ...]) -> DataFrame:
    """feature, place and each metric's sum of today and of the window, ranked by tokens, units, seconds, calls, the features' own order, name."""
    metrics = ("llm_tokens_in", "llm_tokens_out", "youtube_units", "whisper_seconds", "llm_calls")
    total = lambda m, when: F.coalesce(F.sum(F.when(when & (F.col(metric) == m), F.col(amount))), F.lit(0)).cast("long")
    window = (F.col(day) >= F.date_sub(today, days - 1)) & (F.col(day) <= today)
    sums = rows.filter(window & F.col(metric).isin(*metrics)).groupBy(feature).agg(*[total(m, F.lit(True)).alias(m) for m in metrics], *[total(m, F.col(day) == today).alias(f"{m}_today") for m in metrics])
    known = F.coalesce(*[F.when(F.col(feature) == f, i) for i, f in enumerate(features)], F.lit(len(features)))
    order = [F.desc(F.col("llm_tokens_in") + F.col("llm_tokens_out")), F.desc("youtube_units"), F.desc("whisper_seconds"), F.desc("llm_calls"), known, F.col(feature)]
    # One row a feature.
    return sums.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def stance_by_month(docs: DataFrame, at: str, meta: str) -> DataFrame:
    """kind (stance, sentiment), month, counts (label and n, by label) of classified documents; no rows where nothing is classified."""
    dated = docs.filter(F.col(at).isNotNull()).select(F.date_format(at, "yyyy-MM").alias("month"), *[F.get_json_object(meta, f"$.classification.{k}").alias(k) for k in ("stance", "sentiment")])
    out = None
    for kind in ("stance", "sentiment"):
        n = dated.filter(F.coalesce(kind, F.lit("")) != "").groupBy("month", F.col(kind).alias("label")).agg(F.count("*").alias("n"))
        one = n.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("counts")).select(F.lit(kind).alias("kind"), "month", "counts")
        out = one if out is None else out.unionByName(one)
    return out


def script_changes(windows: DataFrame, by: list[str], order: list[str], mode: str, scripts: tuple[str, ...] = ("roman", "native_script")) -> DataFrame:
    """by, changes between windows in a row that carry a script; plain ones are skipped."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = windows.filter(F.col(mode).isin(*scripts)).withColumn("__before", F.lag(mode).over(w))
    return rows.groupBy(*by).agg(F.count_if(F.col("__before") != F.col(mode)).alias("changes"))

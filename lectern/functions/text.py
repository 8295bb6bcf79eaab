"""Text functions: expressions over string columns, and grouped or scalar pandas functions where Spark has no expression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLLAPSE = r"\s+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def sentences(text: str | Column) -> Column:
    """Cut after . ! ? and white space; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(text), r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def sentence_times(df: DataFrame, text: str, start: str, duration: str, keys: list[str]) -> DataFrame:
    """keys, place, sentence, start, duration: a segment's time shared by characters; the last ends just at the segment's end."""
    parts = df.select(*keys, F.col(start).alias("__s"), F.col(duration).alias("__d"), sentences(text).alias("__p"))
    total = F.aggregate("__p", F.lit(0), lambda a, x: a + F.length(x))
    rows = parts.withColumn("__t", total).select("*", F.posexplode("__p").alias("place", "sentence"))
    before = F.coalesce(F.sum(F.length("sentence")).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__b", before)
    before = F.col("__b")
    rows = rows.withColumn("__a", F.col("__s") + F.col("__d") * before / F.col("__t"))
    last = F.col("place") == F.size("__p") - 1
    end = F.when(last, F.col("__s") + F.col("__d")).otherwise(F.col("__s") + F.col("__d") * (before + F.length("sentence")) / F.col("__t"))
    return rows.select(*keys, "place", "sentence", F.col("__a").alias("start"), (end - F.col("__a")).alias("duration"))


def plain_html(html: str | Column, most: int = 50_000) -> Column:
    """Text of HTML: scripts, styles and tags go, white space collapses; beyond most characters it ends with '...'."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), COLLAPSE, " "))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


def headings(html: str | Column, most: int = 14) -> Column:
    """Distinct h2 and h3 headings in order."""
    found = F.regexp_extract_all(_col(html), F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), F.lit(1))
    clean = F.transform(found, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", ""), COLLAPSE, " ")))
    return F.slice(F.array_distinct(F.filter(clean, lambda h: h != "")), 1, most)


def video_id(url: str | Column) -> Column:
    """Of watch, short, embed and shorts addresses."""
    return F.nullif(F.regexp_extract(_col(url), r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def url_key(url: str | Column) -> Column:
    """Host without www., path without trailing slashes, ? and the query without times; null without scheme and host."""
    u = _col(url)
    host = F.regexp_replace(F.lower(F.nullif(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    # Form encoding, as far as it differs: a star is encoded, a tilde is not.
    coded = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    told = F.filter(pairs, lambda p: ~name(p).isin("t", "start"))
    query = F.array_join(F.transform(told, lambda p: F.concat(coded(name(p)), F.lit("="), coded(F.regexp_replace(p, "^[^=]*=?", "")))), "&")
    return F.concat(host, path, F.lit("?"), query)


def clock(seconds: str | Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(_col(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def iso_duration(text: str | Column) -> Column:
    """Seconds of PT#H#M#S; null where it is none."""
    t = _col(text)
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(t, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(t.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$") & (F.length(t) > 1), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


def year_label(year: str | Column) -> Column:
    y = _col(year)
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BCE"))).otherwise(y.cast("string"))


def era_label(start: str, end: str) -> Column:
    s, e = F.col(start), F.coalesce(F.col(end), F.col(start))
    return F.when(s.isNull(), F.lit(None)).when(s == e, year_label(s)).when((s < 0) & (e < 0), F.concat((-s).cast("string"), F.lit("-"), year_label(e))).otherwise(F.concat(year_label(s), F.lit("-"), year_label(e)))


def era_payload(payload: str) -> Column:
    """A struct start, end, confidence of JSON: numbers coerced, swapped if reversed, one bound is a point, confidence in [0, 1] to 2 places."""
    number = lambda k: F.expr(f"try_cast(get_json_object({payload}, '$.{k}') AS int)")
    a, b = number("start"), number("end")
    confidence = F.expr(f"try_cast(get_json_object({payload}, '$.confidence') AS double)")
    low, high = F.least(F.coalesce(a, b), F.coalesce(b, a)), F.greatest(F.coalesce(a, b), F.coalesce(b, a))
    return F.struct(low.alias("start"), high.alias("end"), F.round(F.greatest(F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 2).alias("confidence"))


def sample_windows(text: str | Column, size: int) -> Column:
    """Start, middle and end of a long text by words, joined by lines of [...]."""
    w = F.filter(F.split(_col(text), COLLAPSE), lambda x: x != "")
    n = F.size(w)
    middle = F.slice(w, F.greatest(F.floor(n / 2).cast("int") - size // 2 + 1, F.lit(1)), size)
    tail = F.slice(w, F.greatest(n - size + 1, F.lit(1)), size)
    return F.when(n <= 3 * size, F.array_join(w, " ")).otherwise(F.concat_ws("\n[...]\n", F.array_join(F.slice(w, 1, size), " "), F.array_join(middle, " "), F.array_join(tail, " ")))


def without_visuals(text: str | Column) -> Column:
    """Without [VISUAL ...] marks; white space collapses only if there was one. An open mark stays."""
    t = _col(text)
    return F.when(t.rlike(r"\[VISUAL[^\]]*\]"), F.trim(F.regexp_replace(F.regexp_replace(t, r"\[VISUAL[^\]]*\]", " "), COLLAPSE, " "))).otherwise(t)


# Our own list: words that name no topic.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "was", "what", "with")


def _topic_words(text: Column) -> Column:
    """Words with their inner apostrophes; a possessive 's goes."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\p{M}][\p{L}\p{N}\p{M}'’]*"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, "['’]+$", ""), "(?i)['’]s$", "")), lambda w: w != "")


def firsts(placed: Column) -> Column:
    """Of structs k, i, x the first of each k by i, then x."""
    return bound(F.sort_array(placed), lambda p: F.filter(p, lambda y, n: (n == 0) | (F.get(p, n - 1)["k"] != y["k"])))


def in_order(placed: Column) -> Column:
    """The x of structs k, i, x by i, then x."""
    return F.transform(F.sort_array(F.transform(placed, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def _first_spellings(items: Column) -> Column:
    """Without repeats in another case: sorted by lower case and place, the first of equals, in their order again."""
    return in_order(firsts(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))))


def topic_terms(topic: str | Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The words that carry a topic, in order; a topic of stop words only keeps them all."""
    carrying = lambda words: F.filter(words, lambda w: ~F.lower(F.replace(w, F.lit("’"), F.lit("'"))).isin(*stop_words))
    kept = lambda words: bound(carrying(words), lambda k: F.when(F.size(k) > 0, k).otherwise(words))
    return _first_spellings(bound(_topic_words(_col(topic)), kept))


def topic_queries(topic: str | Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """What to search for, in turn: the topic as written, its carrying words, the first three and the first two of them."""
    written = F.trim(_col(topic))
    asked = bound(topic_terms(topic, stop_words), lambda terms: F.array(written, *[F.array_join(t, " ") for t in (terms, F.slice(terms, 1, 3), F.slice(terms, 1, 2))]))
    return F.when(F.coalesce(written, F.lit("")) == "", F.array().cast("array<string>")).otherwise(_first_spellings(F.filter(asked, lambda q: q != "")))


def _term_key(word: Column) -> Column:
    w = F.lower(word)
    return F.when((F.length(w) > 4) & w.rlike("[^s]s$"), F.left(w, F.length(w) - 1)).otherwise(w)


def topic_keys(topic: str | Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The carrying words in the form they compare in: lower case, without a plural s above four letters."""
    return F.array_distinct(F.transform(topic_terms(topic, stop_words), _term_key))


def term_keys(text: str | Column) -> Column:
    """All words of a text in the form they compare in."""
    return F.array_distinct(F.transform(_topic_words(_col(text)), _term_key))


def words_any_script(text: str | Column) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"), F.lit(0))


#: Scripts other than Latin that words are told apart by.
NATIVE_SCRIPTS = ("Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Gujarati", "Gurmukhi", "Tamil", "Telugu", "Kannada", "Malayalam", "Thai", "Han", "Hiragana", "Katakana", "Hangul")


def native_scripts(word: Column) -> Column:
    """The scripts other than Latin that a text has letters of."""
    return F.array_compact(F.array(*[F.when(word.rlike(rf"\p{{Is{s}}}"), s.upper()) for s in NATIVE_SCRIPTS]))


def _mixed_pattern() -> str:
    """A word with letters of two native scripts: its first one's letters and all that is of none are passed over, and a
    character is left. Each is looked at once; ASCII ones are of no native script."""
    of = lambda names: "".join(rf"\p{{Is{s}}}" for s in names)
    passed = lambda others: rf"[\S&&[\p{{ASCII}}[^{of(others)}]]]*+"
    first = "|".join(rf"\p{{Is{s}}}{passed([x for x in NATIVE_SCRIPTS if x != s])}\S" for s in NATIVE_SCRIPTS)
    return rf"(?<!\S){passed(NATIVE_SCRIPTS)}(?:{first})\S*+"


def mixed_script_words(text: str | Column) -> Column:
    """Words whose letters come from two scripts or more, Latin aside."""
    return F.regexp_extract_all(_col(text), F.lit(_mixed_pattern()), F.lit(0))


def beyond_ascii(text: str | Column) -> Column:
    """A text's characters that are not ASCII: all letters of scripts other than Latin are among them."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\p{ASCII}+", "")


def dominant_script(text: str | Column) -> Column:
    """The script other than Latin with most letters in a text; null for Latin only. Ties go to the first of NATIVE_SCRIPTS."""
    counts = lambda t: F.array_max(F.array(*[F.struct(F.regexp_count(t, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("i"), F.lit(s.upper()).alias("script")) for i, s in enumerate(NATIVE_SCRIPTS)]))
    return bound(bound(beyond_ascii(text), counts), lambda most: F.when(most["n"] > 0, most["script"]))


def slug(heading: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(heading)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def shingles(text: str | Column, n: int) -> Column:
    """Distinct n-word shingles of the lower-cased text."""

    def zipped(w: Column) -> Column:
        count = F.greatest(F.size(w) - (n - 1), F.lit(0))
        out = F.slice(w, 1, count)
        for i in range(2, n + 1):  # zipped, so that the words are not made anew for every shingle
            out = F.zip_with(out, F.slice(w, i, count), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.coalesce(out, F.array().cast("array<string>")))

    return bound(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"\S+"), F.lit(0)), zipped)


# Characters of a phrase's tag, phrases, single words.
TAG_CHARS, TAG_PHRASES, TAG_WORDS = 30, 5, 3


def hashtag(text: str | Column) -> Column:
    return F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}\p{M}]", ""))


def hashtags(topic: str | Column, stop_words: tuple[str, ...] = STOP_WORDS) -> tuple[Column, Column]:
    """(phrases: the topic joined, its carrying words joined, each neighbouring pair of them; single words, longest first, for
    when no phrase finds anything)."""
    tags = F.filter(F.transform(topic_terms(topic, stop_words), hashtag), lambda t: t != "")

    def found(tags: Column) -> Column:
        n = F.greatest(F.size(tags) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(tags, 1, n), F.slice(tags, 2, n), lambda a, b: F.concat(a, b))
        joined = F.array_distinct(F.concat(F.array(hashtag(topic), F.array_join(tags, "")), pairs))
        return F.filter(joined, lambda t: (t != "") & (F.length(t) <= TAG_CHARS))

    def single(tags: Column) -> Column:
        return F.transform(F.array_except(tags, found(tags)), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))

    return F.slice(bound(tags, found), 1, TAG_PHRASES), F.slice(F.transform(F.array_sort(bound(tags, single)), lambda x: x["t"]), 1, TAG_WORDS)


# What a log line must not show, and what stands for it.
REDACTIONS = (
    (r"sk-[A-Za-z0-9_-]{8,}", "sk-***"),
    (r"AIza[A-Za-z0-9_-]{10,}", "AIza***"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", "***"),
    (r"(?i)([?&](?:key|token|access_token|api_key|signature)=)[^&\s]+", "$1***"),
    (r"(?i)(://)[^/\s:@]+:[^/\s@]+@", "$1***@"),
)


def redacted(text: str | Column) -> Column:
    out = _col(text)
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def verbatim_span(quote: str | Column, text: str | Column, least: int = 8) -> Column:
    """The span of a text that a quote copies, whatever the case, white space and kind of quotation marks; null where there is
    none, and for quotes of less than so many characters."""
    q = F.regexp_replace(F.regexp_replace(_col(quote), r"^\s+|\s+$", ""), "^[\"'“”]+|[\"'“”]+$", "")
    q = F.regexp_replace(F.regexp_replace(q, r"^\s+", ""), r"\s+", " ")
    pattern = F.regexp_replace(q, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(pattern, "['‘’]", "['‘’]"), "[\"“”]", "[\"“”]")
    found = F.call_function("regexp_extract", _col(text), F.concat(F.lit("(?iu)"), F.replace(pattern, F.lit(" "), F.lit(r"\s+"))), F.lit(0))
    return F.when(F.length(q) >= least, F.nullif(found, F.lit("")))


# --- where Spark has no expression -----------------------------------------------------------------------------------


def overlap_words(left: list[str], right: list[str], most: int) -> int:
    """Length of the longest suffix of one that is a prefix of the other, in time proportional to the two."""
    n = min(most, len(left), len(right))
    words = [*right[:n], None, *left[len(left) - n :]]
    fits = [0] * len(words)
    for i in range(1, len(words)):
        k = fits[i - 1]
        while k and words[i] != words[k]:
            k = fits[k - 1]
        fits[i] = k + (words[i] == words[k])
    return fits[-1] if n else 0


def reassembled(chunks: DataFrame, doc: str, index: str, text: str, overlap: int = 32) -> DataFrame:
    """doc and text of chunks in order, each without the words it repeats of the one before."""
    kinds = dict(chunks.dtypes)

    def joined(parts) -> str:
        words, last = [], None
        for place, t in sorted(((p["i"], p["t"] or "") for p in parts), key=lambda p: (p[0] is None, p)):
            if (place,) != last:
                new = t.split()
                words += new[overlap_words(words, new, max(4 * overlap, 64)) :]
            last = (place,)
        return " ".join(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({doc: pdf[doc], text: pdf["__parts"].map(joined)})

    # Many documents to a batch; of a chunk that is there more than once the first by its text counts.
    parts = F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))).alias("__parts")
    return chunks.groupBy(doc).agg(parts).mapInPandas(run, f"{doc} {kinds[doc]}, {text} string")


def chunked(df: DataFrame, doc: str, text: str, tokens: int = 256, overlap: int = 32) -> DataFrame:
    """doc, chunk_index, total_chunks, n_tokens, chunk: whole sentences up to a number of words, the next chunk repeating whole trailing sentences worth at most the overlap.

    One row in, its chunks out: no shuffle. A sentence longer than a chunk is a chunk of its own."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, body in zip(pdf[doc], pdf[text]):
                items = [(s, len(s.split())) for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", body or "")) if s]
                chunks, at = [], 0
                while at < len(items):
                    end, total = at, 0
                    while end < len(items) and (end == at or total + items[end][1] <= tokens):
                        total += items[end][1]
                        end += 1
                    chunks.append((total, " ".join(s for s, _ in items[at:end])))
                    if end == len(items):
                        break
                    back, shared = end, 0
                    while back - 1 > at and shared + items[back - 1][1] <= overlap:
                        back -= 1
                        shared += items[back][1]
                    at = back
                out += [(key, i, len(chunks), n, c) for i, (n, c) in enumerate(chunks)]
            yield pd.DataFrame(out, columns=[doc, "chunk_index", "total_chunks", "n_tokens", "chunk"])

    return df.select(doc, text).mapInPandas(run, f"{doc} {kinds[doc]}, chunk_index int, total_chunks int, n_tokens int, chunk string")

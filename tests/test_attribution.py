"""Numbers in words, details of texts and where they are said."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions import details as fn
from lectern.operators import attribution
from tests.conftest import SF

SAID = [
    ("fifteen thousand and two", {"15002"}),
    ("point nine two", {"9", "2", "92", "0.92"}),
    ("one two two", {"1", "2", "122"}),
    ("nineteen eighty-four", {"19", "84", "1984"}),
    ("nineteen oh five", {"19", "0", "5", "1905"}),
    ("a hundred people, 15 thousand cats", {"100", "15", "15000"}),
    ("twenty-first and the third", {"21", "3"}),
    ("15 000 and 17,363.10 v1.10.2", {"15", "0", "15000", "17363.1", "1.10.2"}),
    ("12 point 5", {"12", "5", "12.5"}),
    ("someone often weighs eightfold", set()),
    ("", set()),
    (None, set()),
]


def test_numbers_said(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", fn.spoken_numbers("t").alias("n")).collect()}
    for i, (text, want) in enumerate(SAID):
        assert set(got[i]) == want and len(got[i]) == len(want), text


def test_every_number_is_read_back(spark):
    rng = random.Random(5)
    numbers = sorted({*range(2200), *(rng.randrange(10 ** rng.randrange(3, 12)) for _ in range(2000))})
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    and_said = F.regexp_replace(fn.spelled("n"), "hundred (?!thousand|million|billion)", "hundred and ")
    got = df.select("n", fn.spoken_numbers(fn.spelled("n")).alias("a"), fn.spoken_numbers(and_said).alias("b")).collect()
    assert all(r["a"] == r["b"] == [str(r["n"])] for r in got)


def test_details(spark):
    text = "He said \"about 42 apples\" at 10:20, `df` uses sns.load_dataset('x', n=300), my_var, plot() and CamelCase; 1,250.50, 7, 1984 e.g. 35% of $1200 dpi=300; 1984"
    got = spark.createDataFrame([(text,)], "t string").select(fn.details("t").alias("d")).first()["d"]
    assert [tuple(d) for d in got] == [
        ("quoted", "about 42 apples", True), ("identifier", "df", False), ("identifier", "snsloaddataset", True), ("identifier", "myvar", True),
        ("identifier", "plot", True), ("identifier", "camelcase", True), ("number", "1250.5", True), ("number", "1984", True), ("number", "35", False), ("number", "1200", True),
    ]


CLAIMS = [(1, 'It has "Three red  apples" and 1,984 of my_var'), (2, "42 and 42 and 1984"), (3, None), (4, ""), (5, 'x.plot() "blue sky"'), (5, 'x.plot() "blue sky"')]
SOURCES = [(10, "nineteen eighty-four, three red apples"), (11, "my_var = 1984; a blue, sky"), (12, None), (13, "three red applesauce forty two"), (13, "three red applesauce forty two")]


def test_unsupported(spark):
    rows = [(i, c, s) for i, c in CLAIMS for _, s in SOURCES]
    df = spark.createDataFrame(rows, "id int, claim string, source string")
    got = {(r["id"], r["source"]): {d["key"] for d in r["unsupported"]} for r in attribution.unsupported(df, "claim", "source").collect()}
    assert got[1, SOURCES[0][1]] == {"myvar"}
    assert got[1, SOURCES[1][1]] == {"three red apples"}
    assert got[1, None] == {"three red apples", "1984", "myvar"}
    assert got[2, SOURCES[3][1]] == {"1984"}
    assert got[3, SOURCES[0][1]] == got[4, None] == set()
    assert got[5, SOURCES[1][1]] == {"xplot"}


def test_sources_equal_a_search_of_every_source(spark):
    claims, sources = spark.createDataFrame(CLAIMS, "id int, t string"), spark.createDataFrame(SOURCES, "sid int, t string")
    got = {tuple(r)[:3]: tuple(r)[4:] for r in attribution.sources_of(claims, sources, "id", "t", "sid", "t").collect()}
    assert got == {
        (1, "quoted", "three red apples"): (1, 10), (1, "number", "1984"): (2, 10), (1, "identifier", "myvar"): (1, 11),
        (2, "number", "42"): (1, 13), (2, "number", "1984"): (2, 10), (5, "identifier", "xplot"): (0, None), (5, "quoted", "blue sky"): (1, 11),
    }
    assert attribution.sources_of(claims, sources.limit(0), "id", "t", "sid", "t").filter("n_sources > 0").isEmpty()
    assert attribution.sources_of(claims.limit(0), sources, "id", "t", "sid", "t").isEmpty()


def test_phrases_in_documents(spark):
    """Phrases cut from whole texts are found in as many documents as a plain search finds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = [(r["doc_id"], " " + r["w"] + " ") for r in docs.select("doc_id", fn.phrase_words("text").alias("w")).collect()]
    phrases = sorted({" ".join(w.split()[3:6]) for _, w in held if len(w.split()) > 6 and len(" ".join(w.split()[3:6])) < 90})[:40]
    claims = spark.createDataFrame([(i, f'"{p}"') for i, p in enumerate(phrases)], "id int, t string")
    got = {r["key"]: (r["n_sources"], r["first_source"]) for r in attribution.sources_of(claims, docs, "id", "t", "doc_id", "text").collect()}
    for p in phrases:
        found = {d for d, w in held if re.search(f" {re.escape(p)} ", w)}
        assert got[p] == (len(found), min(found)), p

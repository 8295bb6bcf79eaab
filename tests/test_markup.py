"""HTML that ends, by the rules of HTML."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lectern.functions.markup import TEXT_ONLY, VOID, balanced_html

CASES = {
    "": "",
    "no markup at all": "no markup at all",
    "5 < 6 and <3": "5 < 6 and <3",
    # finished
    "<main><h1>Report</h1><p>One<br>two</main>": "<main><h1>Report</h1><p>One<br>two</main>",
    "<ol><li>first<li>second</ol>": "<ol><li>first<li>second</ol>",
    "<dl><dt>term<dd>meaning<dt>next</dl>": "<dl><dt>term<dd>meaning<dt>next</dl>",
    "<!doctype html><?x y?><i>k</i>": "<!doctype html><?x y?><i>k</i>",
    "<!-- <b> --><i>k</i>": "<!-- <b> --><i>k</i>",
    "<i title=\"1 > 0\">k</i>": "<i title=\"1 > 0\">k</i>",
    "<svg/><use href='#a' /><img alt=x>": "<svg/><use href='#a' /><img alt=x>",
    "end without start</b>": "end without start</b>",
    "<em><b>crossed</em></b>": "<em><b>crossed</em></b>",
    "<style>a > b { } <i></style>": "<style>a > b { } <i></style>",
    "<TITLE>x</title >": "<TITLE>x</title >",
    # open elements
    "<section><em>cut": "<section><em>cut</em></section>",
    "<p>one<table><tr><td>x<td>y": "<p>one<table><tr><td>x<td>y</td></tr></table>",
    "<h2>one<h4>two": "<h2>one<h4>two</h4>",
    "<select><option>a<option>b": "<select><option>a<option>b</option></select>",
    "<ul><li><ul><li>deep": "<ul><li><ul><li>deep</li></ul></li></ul>",
    "<a href=/dir/>x": "<a href=/dir/>x</a>",
    "<a href=k=\"v>x": "<a href=k=\"v>x</a>",
    "<script>if (1 <": "<script>if (1 <</script>",
    "<textarea><p>": "<textarea><p></textarea>",
    "<b>x  \n": "<b>x</b>",
    # tags and comments that do not end
    "see <a href=\"https://host/page": "see",
    "<p>see <a href=\"no end>here</a></p>": "<p>see</p>",
    "<p>x</p": "<p>x</p>",
    "<p>x<!-- note > more": "<p>x</p>",
    "<p>x <": "<p>x</p>",
    "<p>x </ ": "<p>x</p>",
    "<p>x<!DOC": "<p>x</p>",
}


def test_cases(spark):
    df = spark.createDataFrame(list(CASES.items()), "html string, want string")
    bad = df.withColumn("got", balanced_html("html")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not bad
    assert spark.createDataFrame([(None,)], "html string").select(balanced_html("html")).first()[0] is None


class Open(HTMLParser):
    """What strict nesting leaves open; the pages below leave out no end."""

    def __init__(self):
        super().__init__()
        self.left = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.left.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        assert self.left.pop() == tag


def tree(rng, depth=0):
    names = ["div", "em", "span", "q", "b", "ins"] if depth else ["div"]
    inner = [rng.choice(["text ", "a < b ", "<br>", "<img src='x>y'/>", "<!-- <div> -->", "&amp; ", "<script>'<q>'</script>"]) for _ in range(rng.randint(0, 3))]
    if depth < 6:
        inner += [tree(rng, depth + 1) for _ in range(rng.randint(0, 2))]
    rng.shuffle(inner)
    name = rng.choice(names)
    return f"<{name} id=\"i{depth}\" lang=en>{''.join(inner)}</{name}>"


def test_pages_cut_anywhere_end(spark):
    """A page cut at any place is a beginning of it with ends for what is open, and a page that ends stays as it is."""
    rng = random.Random(4)
    pages = [tree(rng) for _ in range(150)]
    cut = [(p, p[: rng.randint(0, len(p))]) for p in pages] + [(p, p) for p in pages]
    df = spark.createDataFrame(cut, "page string, html string")
    for r in df.withColumn("got", balanced_html("html")).collect():
        if r.html == r.page:
            assert r.got == r.page
        body = r.got
        while body and not r.html.startswith(body):
            body = body[: body.rindex("</")]
        assert r.html.startswith(body) and len(r.html[len(body) :].lstrip()) <= max(len(t) for t in r.html.split("<")) + 12
        if not any(f"<{t}" in r.html and f"</{t}>" not in r.got for t in TEXT_ONLY):
            parser = Open()
            parser.feed(r.got)
            parser.close()
            assert not parser.left, r.got


def test_long_and_deep(spark):
    rows = [("<b>" + "x " * 300_000,), ("<i>" * 2000,), ("<p " + "a='1' " * 20_000 + ">t",), ("<" * 50_000,), ("<a " * 20_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "html string").coalesce(1).select(balanced_html("html")).collect()]
    assert got[0].endswith("x</b>") and got[1] == "<i>" * 2000 + "</i>" * 2000 and got[2].endswith(">t</p>") and len(got[3]) < 50_000 and got[4] == ""

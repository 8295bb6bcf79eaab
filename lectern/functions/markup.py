"""HTML that ends: tags found by one expression, open elements kept by a fold over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end, those that hold text only, those whose start ends a paragraph, and for
# each element the siblings that its start ends.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
TEXT_ONLY = ("script", "style", "textarea", "title")
ENDS_P = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
)
ENDS_SIBLINGS = {
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "h1": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "h2": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "h3": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "h4": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "h5": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "h6": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "li": ("li",),
    "option": ("option",),
    "tbody": ("tbody", "td", "tfoot", "th", "thead", "tr"),
    "td": ("td", "th"),
    "tfoot": ("tbody", "td", "tfoot", "th", "thead", "tr"),
    "th": ("td", "th"),
    "thead": ("tbody", "td", "tfoot", "th", "thead", "tr"),
    "tr": ("td", "th", "tr"),
}

_RAW = "|".join(TEXT_ONLY)
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>))"""
#: The rest of a tag up to its >, values whole; every quantifier is possessive, so nothing is tried twice.
_REST = rf"[^>=]*+(?:{_VALUE}[^>=]*+)*+>"
_EMPTY = rf"<[a-z][^\s/>]*+(?:\s++[^\s=>/]++(?:\s*+{_VALUE})?+)*+\s*+/>"
#: A comment; a declaration; an element that ends in itself; one that holds text only, up to its end or that of all; a tag.
_COMPLETE = rf"<!--.*?-->|<(?:!(?!--)|\?)[^>]*+>|{_EMPTY}|<({_RAW})(?=[\s/>]){_REST}(?:.*?</\1\s*+>|.*+)|</?+[a-z]{_REST}"
#: A tag or comment that does not end takes all that follows.
TOKEN = rf"(?is){_COMPLETE}|<(?:[!?]|/?+[a-z]|/?+\s*+\z).*+"
_WHOLE_RAW = rf"(?is)^<({_RAW})\b.*</\1\s*+>\z"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _unfinished(token: Column) -> Column:
    return ~token.rlike(rf"(?is)^(?:{_COMPLETE})\z")


def _after(stack: Column, tag: Column) -> Column:
    """The open elements after a tag: name for a start, /name for an end."""
    name = F.ltrim(tag, F.lit("/"))
    depth = F.size(stack)
    # An end closes the innermost element of its name, and what that holds; without one it closes nothing.
    place = F.array_position(F.reverse(stack), name).cast("int")
    ended = F.when(place > 0, F.slice(stack, F.lit(1), depth - place)).otherwise(stack)
    # A start first ends what stands at the top and can't hold it.
    stays = F.transform(stack, lambda x, i: F.when(_ends(name, x), 0).otherwise(i + 1))
    started = F.concat(F.slice(stack, F.lit(1), F.coalesce(F.array_max(stays), F.lit(0))), F.array(name))
    return F.when(tag.startswith("/"), ended).otherwise(started)


def _ends(name: Column, open_: Column) -> Column:
    """Whether the start of an element ends an open one."""
    pairs = [f"{start} {sibling}" for start, siblings in ENDS_SIBLINGS.items() for sibling in siblings]
    return (open_ == "p") & name.isin(*ENDS_P) | F.concat_ws(" ", name, open_).isin(*pairs)


def open_elements(html: Column) -> Column:
    """Names of the elements still open at the end, outermost first."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^<(/?+[a-zA-Z][^\s/>]*+)", 1))
    opens = F.filter(tokens(html), lambda t: ~_unfinished(t) & t.rlike("^</?+[a-zA-Z]") & ~t.rlike(rf"(?is)^{_EMPTY}\z") & ~t.rlike(_WHOLE_RAW))
    tags = F.filter(F.transform(opens, name), lambda x: ~x.isin(*VOID))
    return F.aggregate(tags, F.array().cast("array<string>"), _after)


def balanced_html(html: str | Column) -> Column:
    """The text cut before a tag or comment that does not end, with a closing tag for all that is still open.

    What is balanced stays as it is, stray closing tags too; null stays null. Time grows with the text and the depth."""
    text = F.col(html) if isinstance(html, str) else html
    last = F.element_at(F.concat(F.array(F.lit("<a>")), tokens(text)), -1)
    tail = F.when(_unfinished(last), F.length(last)).otherwise(0)
    left = open_elements(text)
    closing = F.array_join(F.transform(F.reverse(left), lambda x: F.concat(F.lit("</"), x, F.lit(">"))), "")
    body = F.regexp_replace(F.left(text, F.length(text) - tail), r"\s++\z", "")
    return F.when((tail == 0) & (F.size(left) == 0), text).otherwise(F.concat(body, closing))

"""Details of a text that can be checked elsewhere (quoted phrases, identifiers, figures) and the numbers a text says.

Expressions over string columns. A number in words is found by one regular expression for the whole phrase, so that only
phrases of some twenty words are ever folded, however long the text is.

Defined cases: a null text is the empty text and has no details; equal details of a text are one; numbers from 10**15 on in
words are null and left out; compatibility forms other than the digits and signs of ``FOLDED`` are not folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English number words.
UNITS = "zero one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
UNIT_ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth".split()
TEEN_ORDINALS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TEN_ORDINALS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
# What is written with a point but is no identifier.
ABBREVIATIONS = "e.g i.e a.m p.m u.s u.k vs etc approx no fig dr mr ms".split()
#: Signs and native digits, and what they are read as.
FOLDED = ("’‘“”−०१२३४५६७८९০১২৩৪৫৬৭৮৯", "''\"\"-01234567890123456789")

_VALUES = {"oh": 0}
for _words, _first, _step in ((UNITS, 0, 1), (UNIT_ORDINALS, 0, 1), (TEENS, 10, 1), (TEEN_ORDINALS, 10, 1), (TENS, 20, 10), (TEN_ORDINALS, 20, 10)):
    _VALUES |= {w: _first + i * _step for i, w in enumerate(_words)}


def _any(*lists: list[str]) -> str:
    return "(?:" + "|".join(w for words in lists for w in words) + ")"


_GAP, _AND = r"[\s-]+", r"[\s-]+(?:and\s+)?"
_DIGIT = _any(UNITS, ["oh"])
_PAIR = rf"(?:{_any(TENS)}{_GAP}{_any(UNITS[1:], UNIT_ORDINALS[1:])}\b|{_any(TENS, TEN_ORDINALS, TEENS, TEEN_ORDINALS)}\b)"
_UNDER_100 = rf"(?:{_PAIR}|{_any(UNITS, UNIT_ORDINALS, ['oh'])}\b)"
_HUNDRED = r"hundred(?:th)?\b"
_UNDER_1000 = rf"(?:(?:{_UNDER_100}{_GAP})?{_HUNDRED}(?:{_AND}{_UNDER_100})?|{_UNDER_100})"
_SCALE = rf"(?:{'|'.join(SCALES)})(?:th)?\b"
_SCALED = rf"(?:(?:{_UNDER_1000}|\d+\b){_GAP})?{_SCALE}"
#: How number words and figures begin: most other words are passed by at their first letters.
_OPENS = r"(?=\d|o(?:ne|h)|t(?:w|en|h[iro])|f(?:i|o)|s(?:i|e)|e(?:i|le)|ni|z|hu|mi|bi)"
#: A number in words, perhaps with figures before a scale ("15 thousand").
NUMBER = rf"\b{_OPENS}(?:{_SCALED}(?:{_AND}{_SCALED})*(?:{_AND}{_UNDER_1000})?|{_UNDER_1000})"
PART = rf"\b{_OPENS}(?:{_SCALED}|{_UNDER_1000})"
#: Two numbers of two digits, as years are said; a zero may open the second.
YEAR = rf"\b{_OPENS}({_PAIR}){_GAP}({_PAIR}|oh{_GAP}{_any(UNITS[1:])}\b)"
#: Digits read one by one.
READ_OUT = rf"\b{_OPENS}(?:{_DIGIT}{_GAP})+{_DIGIT}\b"
#: What stands before a point that is said, and the digits after it.
DECIMAL = rf"(?:({NUMBER}|\b\d+)\s+|\b)point((?:\s+(?:{_DIGIT}|\d+)\b)+)"

FIGURE = r"(?<![\w.,:/])[$₹€£]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)*)%?(?![\w]|[.,:]\d)"
STAMP = r"(?<![\d:])\d{1,2}(?::\d{2}){1,2}(?![\d:])"
QUOTED = r'"[^"\n]{3,100}"|“[^”\n]{3,100}”'
IDENTIFIER = r"`[^`\n]{1,60}`|\b[A-Za-z_]\w*(?:(?:\.[A-Za-z_]\w*)+(?:\(\))?|\(\))|\b[A-Za-z]\w*_\w+(?:\(\))?|\b(?:[a-z]+|[A-Z][a-z]+)[A-Z]\w*"
#: Arguments of calls, and assignments: their figures are code.
CODE = r"(?<=[\w.])\((?:[^()]|\([^()]*\))*\)|\b\w+=[^\s,;)]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def folded(text: str | Column) -> Column:
    """Lower-cased, with plain digits and quotation marks, without separators of thousands, spaces made one."""
    plain = F.lower(F.translate(F.coalesce(_col(text), F.lit("")), *FOLDED))
    return F.regexp_replace(F.regexp_replace(plain, r"(?<=\d),(?=\d{3}(?!\d))", ""), r"\s+", " ")


def canonical(figure: Column) -> Column:
    """One spelling for each value: no zeros in front of a number or behind its point; versions (1.10.2) stay."""
    whole = F.regexp_replace(figure, r"^0+(?=\d)", "")
    bare = F.regexp_replace(whole, r"\.?0+$", "")
    return F.when(figure.rlike(r"\..*\."), figure).when(figure.contains("."), F.when(bare == "", "0").otherwise(bare)).otherwise(whole)


def _value_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in _VALUES.items() for x in pair])


def _worth(words: Column) -> Column:
    """The sum of an array of words below a hundred; others are worth nothing, figures themselves."""
    worth = lambda w: F.coalesce(_value_map()[w].cast("decimal(18,0)"), w.try_cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.aggregate(F.transform(words, worth), F.lit(0).cast("decimal(18,0)"), lambda a, x: (a + x).cast("decimal(18,0)"))


def _part_value(part: Column) -> Column:
    """Of a number below a thousand with at most one scale behind it."""
    hundred = lambda words: F.greatest(F.array_position(words, F.lit("hundred")), F.array_position(words, F.lit("hundredth"))).cast("int")

    def value(words: Column, at: Column) -> Column:
        hundreds = F.greatest(_worth(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.lit(1)) * 100
        return F.when(at > 0, hundreds + _worth(F.slice(words, at + 1, F.size(words)))).otherwise(_worth(words))

    small = _bound(F.split(part, _GAP), lambda words: _bound(hundred(words), lambda at: value(words, at)))
    scale = F.lit(1).cast("long")
    for word, worth in SCALES.items():
        scale = F.when(part.rlike(rf"\b{word}(?:th)?$"), F.lit(worth)).otherwise(scale)
    bare = part.rlike(rf"^{_SCALE}$")
    return F.when(bare, scale.cast("decimal(38,0)")).otherwise((small * scale).cast("decimal(38,0)"))


def number_value(phrase: str | Column) -> Column:
    """The value of a number in words, as text; null from 10**15 on."""
    parts = F.transform(F.regexp_extract_all(_col(phrase), F.lit(PART), F.lit(0)), _part_value)
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return _bound(total, lambda t: F.when(t < 10**15, t.cast("long").cast("string")))


def _digits(read: Column) -> Column:
    """Digits in words, or figures, as one string of figures."""
    words = F.filter(F.split(read, _GAP), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(_value_map()[w].cast("string"), w)), "")


def spoken_numbers(text: str | Column) -> Column:
    """Every number a text says, each once: in figures, in words (also ordinals), digit by digit, as a year, with a point."""
    return _bound(folded(text), _said)


def _said(said: Column) -> Column:
    every = lambda pattern, f: F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)), f)
    figures = every(r"\d+(?:\.\d+)*", canonical)
    # A caption's "15 000".
    spaced = every(r"\b\d{1,3}(?: \d{3})+\b", lambda m: canonical(F.replace(m, F.lit(" "))))
    worded = every(NUMBER, number_value)
    years = every(YEAR, lambda m: (number_value(F.regexp_extract(m, YEAR, 1)).cast("long") * 100 + _worth(F.split(F.regexp_extract(m, YEAR, 2), _GAP)).cast("long")).cast("string"))
    read_out = every(READ_OUT, lambda m: canonical(_digits(m)))
    whole = lambda m: F.regexp_extract(m, DECIMAL, 1)
    before = lambda m: F.when(whole(m).rlike(r"^\d+$"), whole(m)).when(whole(m) == "", "0").otherwise(number_value(whole(m)))
    # Only a text that says a point is searched for what stands before it.
    pointed = F.when(said.contains("point"), said).otherwise("")
    decimals = F.transform(F.regexp_extract_all(pointed, F.lit(DECIMAL), F.lit(0)), lambda m: canonical(F.concat(before(m), F.lit("."), _digits(F.regexp_extract(m, DECIMAL, 2)))))
    found = F.concat(figures, spaced, worded, years, read_out, decimals)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def spelled(n: str | Column) -> Column:
    """A whole number from 0 to below 10**12 in words."""
    n, ones, tens = _col(n).cast("long"), F.array(*[F.lit(w) for w in UNITS + TEENS]), F.array(*[F.lit(w) for w in TENS])
    at = lambda words, i: F.get(words, i.cast("int"))

    def below_1000(x: Column) -> Column:
        low = x % 100
        pair = F.concat_ws("-", at(tens, F.floor(low / 10) - 2), F.when(low % 10 > 0, at(ones, low % 10)))
        return F.concat_ws(" ", F.when(x >= 100, F.concat(at(ones, F.floor(x / 100)), F.lit(" hundred"))), F.when(low >= 20, pair).when(low > 0, at(ones, low)))

    parts = [F.when(F.floor(n / s) % 1000 > 0, F.concat(below_1000(F.floor(n / s) % 1000), F.lit(f" {w}"))) for w, s in reversed(SCALES.items())]
    return F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *parts, F.when(n % 1000 > 0, below_1000(n % 1000))))


def compact(text: Column) -> Column:
    """ASCII letters and digits alone, without the words that stand for signs when code is read out."""
    signs = r"\b(?:dot|underscore|brackets?|parenthes[ie]s|comma)\b"
    return F.regexp_replace(F.regexp_replace(folded(text), signs, " "), "[^a-z0-9]+", "")


def phrase_words(text: str | Column) -> Column:
    """Folded words with one space between them; of the signs only points and underscores are kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_\s.]+", " "), r"\s+", " "))


def details(text: str | Column) -> Column:
    """Array of (kind, key, strong): a text's quoted phrases, identifiers and figures, in this order, each key once.

    What was taken is blanked before the next kind is looked for, so that a figure in a quotation or an identifier is no
    detail of its own. Times and what is code are none; nor is a single digit. strong: specific enough to stand alone."""
    return _bound(F.coalesce(_col(text), F.lit("")), _found)


def _found(plain: Column) -> Column:
    every = lambda source, pattern: F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    row = lambda kind, key, strong: F.struct(F.lit(kind).alias("kind"), key.alias("key"), strong.alias("strong"))

    phrase = F.transform(every(plain, QUOTED), phrase_words)
    quoted = F.transform(F.filter(phrase, lambda k: F.length(k) >= 3), lambda k: row("quoted", k, k.contains(" ") | (F.length(k) >= 6)))
    rest = F.regexp_replace(F.regexp_replace(plain, QUOTED, " "), STAMP, " ")

    names = F.transform(every(rest, IDENTIFIER), lambda i: F.trim(F.replace(i, F.lit("`"))))
    names = F.filter(names, lambda i: i.rlike(r"^[^0-9].*") & i.rlike(r"[^._()\s]{2}") & ~F.rtrim(F.lower(i), F.lit(".")).isin(ABBREVIATIONS))
    named = F.transform(names, lambda i: row("identifier", compact(i), (F.length(compact(i)) >= 4) & i.rlike(r"[._(]|[a-z][A-Z]")))
    named = F.filter(named, lambda d: d["key"] != "")
    rest = F.regexp_replace(F.regexp_replace(rest, CODE, " "), IDENTIFIER, " ")

    figures = F.transform(every(rest, FIGURE), lambda f: F.regexp_replace(f, r"[$₹€£%]", ""))
    figures = F.filter(figures, lambda f: f.rlike(r"\d\D*\d"))
    counted = F.transform(figures, lambda f: row("number", canonical(F.replace(f, F.lit(","))), f.rlike(r"[.,]|^\d{3}")))
    found = F.concat(quoted, named, counted)
    return F.filter(F.array_distinct(found), lambda d: d["key"] != "")

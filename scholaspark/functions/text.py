"""Column functions on text. All but NFC are expressions of the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks as Unicode has them, and the separators U+001C to U+001F.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def fold(text: Column) -> Column:
    """Stripped, in lower case: how names are compared in lookups."""
    return F.lower(strip(text))


def safe_value(text: Column) -> Column:
    """A graph value: null is empty, stripped, without control characters but
    tab, line feed and carriage return."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def without_controls(text: Column) -> Column:
    """Without characters of Unicode's category C, but line feed and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Pure ASCII, which NFC leaves alone, stays in the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text))


def collapsed(text: Column) -> Column:
    """At most one blank line and one blank in a row; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def prepared(text: Column) -> Column:
    """The cleaning that comes before chunking."""
    return collapsed(nfc(without_controls(text)))


def reading_text(text: Column) -> Column:
    """Light cleaning of extracted text: form feeds are line ends, words
    divided at a line's end are joined, and blank lines collapse."""
    text = F.regexp_replace(text, "\f", "\n")
    text = F.regexp_replace(text, r"(?U)-\n(\w)", "$1")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def lines(text: Column) -> Column:
    """The stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


#: How lines begin that can't be a title, how a heading is numbered,
#: what stands between names, and what ends an abstract.
NO_TITLE = r"(?i)^(arXiv|preprint|submitted|published|copyright)"
NUMBER = r"^(?:\d+|[IVX]+)\.?"
NUMBERED = rf"{NUMBER}\s+"
TITLED = r"[A-Z].{2,60}"
NAMES = r",\s*|\s+and\s+"
AFTER_ABSTRACT = r"(?i)^(?:1[.\s]|I[.\s]|Introduction|Keywords)"
#: The first lines looked at, a title's least size and its lines, the
#: sizes of a name and the number of names of a line of authors, most characters of
#: an abstract and of a section's text, and those in which a year is looked for.
TOP, LEAST_TITLE, TITLE_LINES, NAME, AUTHORS, ABSTRACT, SECTION, YEAR_WITHIN = 5, 5, 2, (3, 49), 20, 2000, 5000, 500


def title_of(text: Column) -> Column:
    """The first lines near the top that can be a title, joined."""
    able = lambda x: (F.length(x) >= LEAST_TITLE) & ~x.rlike(NO_TITLE)
    return F.array_join(F.slice(F.filter(F.slice(lines(_there(text)), 1, TOP), able), 1, TITLE_LINES), " ")


def authors_of(text: Column) -> Column:
    """The names of the first line below the top one that lists names: it has a
    comma, no long number, and a bounded number of parts of a name's size."""
    named = lambda line: F.filter(F.transform(F.split(line, NAMES), strip), lambda n: F.length(n).between(*NAME))
    below = F.filter(F.slice(lines(_there(text)), 2, TOP), lambda x: x.rlike(r"^(?!.*\d{4}).*,"))
    lists = F.filter(F.transform(below, named), lambda n: F.size(n).between(1, AUTHORS))
    return F.coalesce(F.get(lists, F.lit(0)), F.array().cast("array<string>"))


def abstract_of(text: Column) -> Column:
    """The lines from the one that begins with Abstract to the first heading
    after its first words, as one line; empty if no heading follows."""

    def said(rows: Column) -> Column:
        until = lambda end: F.when(end > 0, F.array_join(F.slice(rows, 1, end), " "))
        return _let(_first(F.slice(rows, 2, F.size(rows)), AFTER_ABSTRACT), until)

    def of_lines(rows: Column, first: Column) -> Column:
        opening = F.regexp_replace(F.get(rows, first - 1), r"(?i)^abstract[:\s]*", "")
        return _let(F.filter(F.concat(F.array(opening), F.slice(rows, first + 1, F.size(rows))), lambda x: x != ""), said)

    found = _let(lines(_there(text)), lambda rows: _let(_first(rows, r"(?i)^abstract"), lambda first: F.when(first > 0, of_lines(rows, first))))
    return F.coalesce(F.left(found, F.lit(ABSTRACT)), F.lit(""))


def year_of(doc_id: Column, text: Column) -> Column:
    """The year of a dated id (yymm.number), else the first 201x or 202x near
    the top of the text."""
    dated = F.nullif(F.regexp_extract(doc_id, r"^(\d{2})\d{2}\.", 1), F.lit("")).cast("int")
    said = F.nullif(F.regexp_extract(F.left(text, F.lit(YEAR_WITHIN)), r"20[12]\d", 0), F.lit("")).cast("int")
    return F.coalesce(dated + F.when(dated < 50, 2000).otherwise(1900), said)


def sections_of(text: Column) -> Column:
    """Array of (heading, text): a line that begins with a capital and with a
    number, on the same line or the one before, is a heading, and what follows it
    up to the next is its text. Neither the first nor the last line is one."""

    def between(rows: Column, at: Column) -> Column:
        after = lambda k: F.coalesce(F.get(at, k + 1)["begin"], F.size(rows))
        body = lambda h, k: strip(F.array_join(F.slice(rows, h["line"] + 2, after(k) - h["line"] - 1), "\n"))
        return F.transform(at, lambda h, k: F.struct(F.regexp_replace(h["said"], NUMBERED, "").alias("heading"), F.left(body(h, k), F.lit(SECTION)).alias("text")))

    def headings(full: Column, size: Column) -> Column:
        heading = lambda begin, at: F.when((begin["i"] > 0) & (at["i"] < size - 1), F.struct(begin["i"].alias("begin"), at["i"].alias("line"), at["x"].alias("said")))
        one = lambda x: x["x"].rlike(rf"{NUMBERED}{TITLED}$")
        two = lambda x, k: x["x"].rlike(rf"{NUMBER}$") & F.coalesce(F.get(full, k + 1)["x"].rlike(rf"^{TITLED}$"), F.lit(False))
        return F.array_compact(F.transform(full, lambda x, k: F.when(one(x), heading(x, x)).when(two(x, k), heading(x, F.get(full, k + 1)))))

    def of_rows(rows: Column) -> Column:
        full = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), strip(x).alias("x"))), lambda r: r["x"] != "")
        return _let(full, lambda f: _let(headings(f, F.size(rows)), lambda at: between(rows, at)))

    return _let(F.split(_there(text), "\n"), of_rows)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _there(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _first(rows: Column, pattern: str) -> Column:
    """The place, from 1, of the first row that fits the pattern, or 0."""
    return F.array_position(F.transform(rows, lambda x: x.rlike(pattern)), True).cast("int")


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("__chunk_"), index.cast("string"))


def doc_of_chunk(chunk: Column) -> Column:
    """The document of a chunk, as the benchmark reads it: up to the first __."""
    return F.substring_index(chunk, "__", 1)


def doc_of_chunk_last(chunk: Column) -> Column:
    """The document of a chunk whose id may hold __ : up to the last __chunk_."""
    return F.regexp_replace(chunk, r"__chunk_(?!.*__chunk_).*$", "")

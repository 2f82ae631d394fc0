"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """White space, no-break spaces included, becomes single spaces; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# fixed values: a piece of a word in camel case, and what tells that a word is in camel case
PIECE, CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", (r"[a-z][A-Z]", r"[A-Z][A-Z][a-z]")


def head(text: Column) -> Column:
    """Normal form of a head word: null for identifiers, camel case split, lower case."""
    parts = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    camel = text.rlike(CAMEL[0]) | text.rlike(CAMEL[1])
    unusable = (F.length(text) == 0) | ~text.rlike(r"\p{L}") | text.rlike(r"[._/]") | text.rlike(r"[0-9]")
    return F.when(text.rlike("^[a-z]+$"), text).when(text.isNull() | unusable, F.lit(None)).when(camel, F.lower(F.array_join(parts, " "))).otherwise(F.lower(text))


def lexicon_key(text: Column, compat: bool = False) -> Column:
    """Normal form of a lexicon term.  By default runs of capitals split like heads do; with compat only
    a small letter or digit before a capital splits."""
    camel = text if compat else F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    camel = F.regexp_replace(camel, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(camel, r"[^A-Za-z0-9]+", " ")))


def slug(text: Column, words: int = 5) -> Column:
    found = F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, words), "-")
    return F.when(found == "", "case").otherwise(found)


def heading_slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\- ]", "")
    out = F.regexp_replace(F.trim(F.regexp_replace(F.trim(kept), " ", "-")), "-+", "-")
    return F.when(out == "", "section").otherwise(out)


def toml_string(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


# fixed values: inline markup and what stays of it, in the order in which it is taken away
MARKUP = (
    (r"!\[[^\]]*\]\([^)]*\)", ""),  # image
    (r"\[\^[^\]]*\]", ""),  # mark of a footnote
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),  # link
    (r"`([^`]*)`", "$1"),  # code
    (r"\*\*\*([^*]+)\*\*\*", "$1"),  # strong and emphasised
    (r"(\*\*|__)(.+?)\1", "$2"),  # strong
    (r"(?<!\w)([*_])([^*_]+)\1(?!\w)", "$2"),  # emphasised
)


def markdown_inline(text: Column) -> Column:
    """Markup inside a line goes, the words stay."""
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, pattern, to)
    return clean(text)

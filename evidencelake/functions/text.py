"""Text helpers built from native string and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d[\d,]*(?:\.\d+)?"
DISPLAY_CHARS = 240


def nullish(c: Column) -> Column:
    """NULL or the empty string."""
    return c.isNull() | (c.cast("string") == "")


def to_number(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").try_cast("double")


def numbers_in(text: Column) -> Column:
    """Numbers written in a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), to_number)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def question_terms(text: Column, longer_than: int, first: int | None = None) -> Column:
    """Lower-case alphanumeric words longer than ``longer_than`` characters, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > longer_than)
    return words if first is None else F.slice(words, 1, first)


def mentions_any(text: Column, terms: Column) -> Column:
    """True when any of the terms occurs in the text, case-insensitively."""
    low = F.lower(text)
    return F.exists(terms, lambda t: F.contains(low, F.lower(t)))


def query_shape(sql: Column) -> Column:
    """The whole text with literals folded to ``?`` and whitespace collapsed."""
    s = F.regexp_replace(sql, r"'(?:[^'\\]|\\.|'')*'", "?")
    s = F.regexp_replace(s, r"\b\d+(?:\.\d+)?\b", "?")
    # lists of literals count as one
    s = F.regexp_replace(s, r"\?(?:\s*,\s*\?)+", "?..")
    return F.regexp_replace(s, r"\s+", " ")


def truncate(text: Column, chars: int = DISPLAY_CHARS) -> Column:
    """Collapsed text, with an ellipsis when something was cut for display."""
    flat = collapse(text)
    return F.when(F.length(flat) > chars, F.concat(F.left(flat, F.lit(chars)), F.lit("…"))).otherwise(flat)


def first_sentence(md: Column) -> Column:
    """The first sentence of a definition; the whole of it when no sentence ends."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(md, r"\n+", " "), r"\*\*", ""))
    sentence = F.regexp_extract(flat, r"^(.*?[.;])\s", 1)
    return F.trim(F.when(sentence != "", sentence).otherwise(flat))


def normalised(text: Column) -> Column:
    """Lower-case words and digits separated by single spaces."""
    return collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))


def category(entity: Column) -> Column:
    """``table:orders`` -> ``table``."""
    return F.element_at(F.split(entity, ":"), 1)


def entity_name(entity: Column) -> Column:
    """``table:orders`` -> ``orders``."""
    return F.regexp_replace(entity, "^[^:]*:", "")

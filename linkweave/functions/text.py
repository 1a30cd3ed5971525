"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import constants as C

ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; inside a lambda a plain column is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(col: Column) -> Column:
    """Trim every Unicode white-space character, not only U+0020."""
    return F.btrim(col, F.lit(C.WS_CHARS))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def or_else(col: Column, default: Column | str) -> Column:
    """The column, or the default where it is null or empty."""
    return F.coalesce(blank_to_null(col), F.lit(default))


def split_ws(col: Column) -> Column:
    return F.split(col, f"[{C.WS_CLASS}]+")


def is_blank(col: Column) -> Column:
    return F.coalesce(trim_ws(col) == "", F.lit(True))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    plain = F.length(col)
    return F.when(F.octet_length(col) == plain, plain).otherwise(
        plain + F.regexp_count(col, F.lit(ASTRAL))
    )


def keywords(col: Column) -> Column:
    """Lower-case words in text order, repeats kept, words of under three UTF-16 units and stop words dropped.

    Digits are separators, so no word can be a number.  The short form of the separators splits a
    text without wider white space the same way, several times faster.
    """
    lower = F.lower(col)
    words = F.when(col.rlike(C.BEYOND_ASCII_SPACE), F.split(lower, C.KEYWORD_SEPARATORS)).otherwise(
        F.split(lower, C.KEYWORD_SEPARATORS_ASCII)
    )
    return F.filter(
        words,
        lambda w: ((F.length(w) >= C.KEYWORD_MIN_LENGTH) | ((F.length(w) == 2) & w.rlike(ASTRAL)))
        & ~w.isin(*C.STOP_WORDS),
    )


def link_keywords(title: Column, description: Column) -> Column:
    """Keywords of a link: those of its title and description together."""
    return keywords(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def decode_entities(col: Column) -> Column:
    """Decode the known HTML entities; &amp; comes last so that nothing is decoded twice."""
    for entity, text in C.HTML_ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(text))
    return col


def json_string(col: Column) -> Column:
    """One string as JSON text."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def tags_text(tags: Column) -> Column:
    """A tag array as JSON text with a space after each comma, the form text search looks at."""
    return F.concat(F.lit("["), F.array_join(F.transform(tags, json_string), ", "), F.lit("]"))


def js_slice_end(count: Column, size: Column) -> Column:
    """How many leading items a slice up to `count` keeps; a negative count drops from the end."""
    return F.greatest(F.lit(0), F.when(count >= 0, F.least(count, size)).otherwise(size + count))

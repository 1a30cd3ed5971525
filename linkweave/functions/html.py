"""Page metadata as column expressions over the HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions.text import blank_to_null, decode_entities, trim_ws
from linkweave.functions.urls import title_from_url


def meta_pattern(attr: str, name: str) -> str:
    """The pattern of a meta element whose `attr` is `name`; group 1 is its content."""
    return C.META_PATTERN.format(ws=C.WS_CLASS, attr=attr, name=name)


def first_meta(html: Column, attr: str, name: str) -> Column:
    """Content of the first such meta element, trimmed; '' when there is none."""
    return trim_ws(F.regexp_extract(html, meta_pattern(attr, name), 1))


def _first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def raw_title(html: Column) -> Column:
    return trim_ws(F.regexp_extract(html, C.TITLE_PATTERN, 1))


def found_title(html: Column) -> Column:
    """The title element, else the Open Graph title."""
    return _first_filled(raw_title(html), first_meta(html, "property", "og:title"))


def found_description(html: Column) -> Column:
    """The meta description, else the Open Graph one, else the Twitter one."""
    return _first_filled(
        first_meta(html, "name", "description"),
        first_meta(html, "property", "og:description"),
        first_meta(html, "name", "twitter:description"),
    )


def page_title(html: Column, url: Column) -> Column:
    decoded = blank_to_null(decode_entities(found_title(html)))
    return F.substring(F.coalesce(decoded, title_from_url(url)), 1, C.MAX_TITLE)


def page_description(html: Column) -> Column:
    return F.substring(decode_entities(found_description(html)), 1, C.MAX_DESCRIPTION)


def page_image(html: Column) -> Column:
    return blank_to_null(first_meta(html, "property", "og:image"))


def fetch_outcome(html: Column, status: Column, content_type: Column, n_bytes: Column) -> Column:
    """'error' for a bad status, 'fallback' for a page that cannot be read as HTML, else 'ok'."""
    bad_status = F.coalesce((status < 200) | (status > 299), F.lit(False))
    not_html = ~F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html"))
    too_big = F.coalesce(n_bytes > C.MAX_PAGE_BYTES, F.lit(False))
    return (
        F.when(bad_status, F.lit("error"))
        .when(html.isNull() | status.isNull() | not_html | too_big, F.lit("fallback"))
        .otherwise(F.lit("ok"))
    )

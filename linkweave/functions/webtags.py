"""Tags that a page declares itself: extraction, scoring and inclusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import json_text
from linkweave.functions.html import meta_pattern
from linkweave.functions.tagging import add_up_to, high_scorers
from linkweave.functions.text import bind, trim_ws, utf16_length

def _cleaned(tags: Column, low: int = 1, high: int = C.MAX_PAGE_TAG_LENGTH) -> Column:
    return F.filter(
        F.transform(tags, lambda t: F.lower(trim_ws(t))),
        lambda t: (utf16_length(t) >= low) & (utf16_length(t) <= high),
    )


def _listed_in_meta(html: Column, name: str) -> Column:
    return _cleaned(F.split(F.regexp_extract(html, meta_pattern("name", name), 1), "[,;]"))


def meta_keywords(html: Column) -> Column:
    return _listed_in_meta(html, "keywords")


def cms_tags(html: Column) -> Column:
    return _listed_in_meta(html, "tags")


def article_tags(html: Column) -> Column:
    return _cleaned(F.regexp_extract_all(html, F.lit(meta_pattern("name", "article:tag")), F.lit(1)))


def _item_tags(item: Column) -> Column:
    words = F.try_variant_get(item, "$.keywords", "variant")
    is_text = F.coalesce(F.schema_of_variant(words) == "STRING", F.lit(False))
    listed = F.when(
        is_text, F.transform(F.split(words.cast("string"), ","), trim_ws)
    ).otherwise(json_text.strings(json_text.members(words)))
    tags = json_text.strings(json_text.members(F.try_variant_get(item, "$.tags", "variant")))
    about = F.transform(
        json_text.members(F.try_variant_get(item, "$.about", "variant")),
        lambda a: F.try_variant_get(a, "$.name", "variant"),
    )
    names = json_text.strings(about)
    return F.concat(listed, tags, names)


def json_ld_tags(html: Column) -> Column:
    """Keywords, tags and topics of every JSON-LD block; blocks that are not JSON are passed over."""
    pattern = C.JSON_LD_PATTERN.format(ws=C.WS_CLASS)
    blocks = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    parsed = F.filter(F.transform(blocks, json_text.parse_strict), lambda v: v.isNotNull())
    items = F.flatten(
        F.transform(
            parsed,
            lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>")).otherwise(
                F.array(v)
            ),
        )
    )
    found = F.flatten(F.transform(items, _item_tags))
    kept = F.filter(found, lambda t: (t != "") & (utf16_length(t) <= C.MAX_PAGE_TAG_LENGTH))
    return F.transform(kept, F.lower)


def taxonomy_links(html: Column) -> Column:
    texts = F.regexp_extract_all(html, F.lit(C.TAXONOMY_LINK_PATTERN), F.lit(1))
    return F.filter(_cleaned(texts, 2, 20), lambda t: ~F.contains(t, F.lit(" ")))


def page_tags(html: Column) -> Column:
    """Tags of all five places in order, first occurrence kept, ten at most."""
    found = F.concat(
        meta_keywords(html), article_tags(html), cms_tags(html), json_ld_tags(html), taxonomy_links(html)
    )
    return F.slice(F.array_distinct(found), 1, C.MAX_PAGE_TAGS)


def _points(condition: Column, n: int) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def _content(title: Column, description: Column) -> Column:
    """struct<text, words> of a link's lower-cased title and description."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.struct(text.alias("text"), F.split(text, f"[{C.WS_CLASS}]+").alias("words"))


def _score(tag: Column, content: Column) -> Column:
    name = F.lower(trim_ws(tag))
    tag_words = F.split(name, rf"[{C.WS_CLASS}\-_]+")
    matching = F.size(F.filter(tag_words, lambda w: F.array_contains(content["words"], w)))
    return (
        F.lit(5)
        + _points(F.contains(content["text"], name), 8)
        + matching * 2
        + _points(utf16_length(name) > 20, -3)
        + _points(name.rlike("[0-9]"), -2)
        + _points(~F.contains(name, F.lit(" ")) & (utf16_length(name) > 2), 1)
    )


def page_tag_score(tag: Column, title: Column, description: Column) -> Column:
    """Points of one tag a page declares, by how well it fits the title and description."""
    return bind(_content(title, description), lambda content: _score(tag, content))


def scored_page_tags(tags: Column, title: Column, description: Column) -> Column:
    """array<struct<tag, score>> of the tags that reach the minimum score."""
    scored = bind(
        _content(title, description),
        lambda content: F.transform(
            tags, lambda t: F.struct(t.alias("tag"), _score(t, content).cast("double").alias("score"))
        ),
    )
    return F.filter(scored, lambda s: s["score"] >= C.MIN_PAGE_TAG_SCORE)


def include_existing_and_page_tags(current: Column, existing: Column, page: Column) -> Column:
    """Strong vocabulary matches first, then strong page tags that are not among them."""
    strong_existing = high_scorers(existing, C.HIGH_SCORE, current)
    strong_page = high_scorers(page, C.HIGH_PAGE_TAG_SCORE, F.concat(current, strong_existing))
    return add_up_to(current, F.concat(strong_existing, strong_page))

"""Prompts, replies and the merging of tags around a model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import json_text
from linkweave.functions.text import js_slice_end, or_else, trim_ws, utf16_length
from linkweave.functions.validation import clean_tags


def _fill(template: str, url: Column, title: Column, description: Column, tags: Column | None = None) -> Column:
    """The template with each @name@ replaced once; filled-in text is not looked at again."""
    values = {
        "url": or_else(url, C.PROMPT_UNKNOWN),
        "title": or_else(title, C.PROMPT_UNKNOWN),
        "description": or_else(description, C.PROMPT_NO_DESCRIPTION),
        "tags": F.array_join(tags, ", ") if tags is not None else F.lit(""),
    }
    parts, rest = [], template
    for name, value in values.items():
        before, mark, after = rest.partition(f"@{name}@")
        if mark:
            parts += [F.lit(before), value]
            rest = after
    return F.concat(*parts, F.lit(rest))


def tag_prompt(url: Column, title: Column, description: Column, matched: Column) -> Column:
    """The first prompt; it names the matched vocabulary tags when there are any."""
    return F.when(
        F.size(matched) > 0, _fill(C.TAG_PROMPT_WITH_MATCHES, url, title, description, matched)
    ).otherwise(_fill(C.TAG_PROMPT, url, title, description))


def prompt_content(title: Column, description: Column) -> Column:
    return trim_ws(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def specificity_prompt(url: Column, title: Column, description: Column, candidates: Column) -> Column:
    return _fill(C.SPECIFICITY_PROMPT, url, title, description, candidates)


def specificity_content(candidates: Column) -> Column:
    return F.concat(F.lit(C.SPECIFICITY_MESSAGE), F.array_join(candidates, ", "))


def _bracketed(reply: Column) -> Column:
    return F.regexp_extract(F.coalesce(reply, F.lit("")), C.JSON_ARRAY_PATTERN, 0)


def reply_tags(reply: Column) -> Column:
    """Tags in the first reply, cleaned; [] without brackets; null when the reply is empty or not JSON."""
    text = _bracketed(reply)
    parsed = json_text.parse_strict(text)
    cleaned = F.filter(
        F.transform(json_text.strings(json_text.members(parsed)), lambda t: trim_ws(F.lower(t))),
        lambda t: (t != "") & (utf16_length(t) <= C.MAX_REPLY_TAG_LENGTH),
    )
    return (
        F.when(F.coalesce(reply, F.lit("")) == "", F.lit(None))
        .when(text == "", F.array().cast("array<string>"))
        .when(parsed.isNotNull(), F.slice(cleaned, 1, C.MAX_REPLY_TAGS))
    )


def protected_tags(tags: Column, matched: Column) -> Column:
    return F.filter(tags, lambda t: F.array_contains(matched, t))


def candidate_tags(tags: Column, matched: Column) -> Column:
    return F.filter(tags, lambda t: ~F.array_contains(matched, t))


def filtered_tags(initial: Column, matched: Column, reply: Column) -> Column:
    """Protected tags and what the second reply keeps; the initial tags when that cannot be read or is nothing."""
    parsed = json_text.parse_strict(_bracketed(reply))
    kept = F.concat(protected_tags(initial, matched), json_text.strings(json_text.members(parsed)))
    asked = F.size(candidate_tags(initial, matched)) > 0
    return F.when(asked & parsed.isNotNull() & (F.size(kept) > 0), kept).otherwise(initial)


def high_scorers(scored: Column, threshold: int, present: Column) -> Column:
    """Tags of array<struct<tag, score>> at or above the threshold and not present; best first, stable."""
    keyed = F.transform(
        scored, lambda s, i: F.struct((-s["score"]).alias("k"), i.alias("i"), s["tag"].alias("tag"))
    )
    wanted = F.filter(keyed, lambda s: (s["k"] <= -threshold) & ~F.array_contains(present, s["tag"]))
    return F.transform(F.array_sort(wanted), lambda s: s["tag"])


def add_up_to(current: Column, extra: Column, limit: int = C.MAX_TAGS) -> Column:
    """Append leading extras up to the limit; beyond the limit the count is negative and cuts from the end."""
    n = js_slice_end(F.lit(limit) - F.size(current), F.size(extra))
    return F.concat(current, F.slice(extra, F.lit(1), n))


def add_high_scorers(current: Column, scored: Column) -> Column:
    """Append strong vocabulary matches that are missing."""
    return add_up_to(current, high_scorers(scored, C.HIGH_SCORE, current))


def manual_first(manual: Column, generated: Column) -> Column:
    """Manual tags, then generated ones, eight at most; without manual tags the generated ones as they are."""
    has_manual = F.coalesce(F.size(manual) > 0, F.lit(False))
    return F.when(has_manual, F.slice(F.concat(manual, generated), 1, C.MAX_TAGS_WITH_MANUAL)).otherwise(generated)


def final_tags(manual: Column, generated: Column) -> Column:
    """Ordered union of manual and (capped) generated tags, then cleaned.  All manual tags stay."""
    none = F.array().cast("array<string>")
    return clean_tags(F.array_distinct(F.concat(F.coalesce(manual, none), manual_first(manual, generated))))

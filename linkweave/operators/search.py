"""Lookups and searches over the links table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions.text import tags_text
from linkweave.schemas import LINK_VIEW


@dataclass
class SearchResult:
    links: DataFrame
    total: DataFrame
    query: str


def find_by_id(links: DataFrame, link_id: int) -> DataFrame:
    return links.filter(F.col("id") == link_id).select(*LINK_VIEW)


def find_by_url(links: DataFrame, url: str, user_id: str) -> DataFrame:
    return links.filter((F.col("url") == url) & (F.col("user_id") == user_id)).select(*LINK_VIEW)


def like_pattern(query: str) -> str:
    """%query%.  % and _ stay wildcards and a backslash escapes; before other characters it has no effect."""
    return re.sub(r"\\([^%_\\])", r"\1", f"%{query}%", flags=re.S)


def _pieces(pattern: str) -> list[str] | None:
    """The regexes between the % signs of a pattern that starts and ends with one; None for other patterns."""
    pieces, piece, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            piece += re.escape(pattern[i])
        elif c == "%":
            pieces.append(piece)
            piece = ""
        else:
            piece += "." if c == "_" else re.escape(c)
        i += 1
    return pieces[1:] if piece == "" and pieces[0] == "" else None


def like_matcher(query: str) -> Callable[[Column], Column]:
    """Case-insensitive %query% as a condition on a text column.

    Each piece between % signs is searched once, after the piece before it; the first place it
    occurs is always good enough, so long texts take time in proportion to their length.
    """
    pattern = like_pattern(query)
    pieces = _pieces(pattern.lower())
    if pieces is None:
        return lambda text: text.ilike(pattern)
    wanted = [p for p in pieces if p]
    if len(wanted) == 1 and not re.search(r"[%_\\]", query):
        return lambda text: F.contains(F.lower(text), F.lit(query.lower()))
    in_order = "(?s)^" + "".join(f"(?>.*?{p})" for p in wanted)
    return lambda text: F.lower(text).rlike(in_order)


def text_condition(query: str | None) -> Column:
    """Title, description, URL or the tags as text contain the query; true without a query."""
    if not query:
        return F.lit(True)
    matches = like_matcher(query)
    found = F.lit(False)
    for place in (F.col("title"), F.col("description"), F.col("url"), tags_text(F.col("tags"))):
        found = found | F.coalesce(matches(place), F.lit(False))
    return found


def tag_condition(tags: list[str] | None) -> Column:
    """Any of the tags is present, case counts; true without tags."""
    if not tags:
        return F.lit(True)
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def newest_first(links: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest first; the id decides between equal times.  0 means no limit and no offset."""
    ordered = links.orderBy(F.desc("created_at"), F.desc("id"))
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit else ordered


def search(
    links: DataFrame,
    user_id: str,
    query: str | None = None,
    tags: list[str] | None = None,
    limit: int | None = None,
    offset: int | None = None,
    total_mode: str = "text",
) -> SearchResult:
    """A user's links by text and tags.  The total leaves the tag condition out unless total_mode='filtered'."""
    by_text = links.filter((F.col("user_id") == user_id) & text_condition(query))
    by_both = by_text.filter(tag_condition(tags))
    counted = by_both if total_mode == "filtered" else by_text
    return SearchResult(
        newest_first(by_both, limit, offset).select(*LINK_VIEW),
        counted.agg(F.count(F.lit(1)).alias("total")),
        query or "",
    )


def top_per_user(links: DataFrame, limit: int) -> DataFrame:
    """Each user's newest links.  The limit is applied before and after the shuffle."""
    order = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        links.select(*LINK_VIEW)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .withColumn("position", F.col("position").cast("long"))
    )


def recent(links: DataFrame, user_id: str, limit: int = C.RECENT_LIMIT) -> DataFrame:
    return newest_first(links.filter(F.col("user_id") == user_id), limit).select(*LINK_VIEW)


def search_all_users(
    links: DataFrame, query: str | None = None, tags: list[str] | None = None, limit: int = C.SEARCH_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """The same search for every user at once: (newest matches per user, totals per user)."""
    by_text = links.filter(text_condition(query))
    totals = by_text.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return top_per_user(by_text.filter(tag_condition(tags)), limit), totals

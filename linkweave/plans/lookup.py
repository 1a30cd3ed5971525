"""Answers to search commands, lookups and deletions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.operators import search as S
from linkweave.operators import store
from linkweave.schemas import LINK_VIEW


@dataclass
class SearchPage:
    """shown: the first rows; found: how many rows came back; total: how many match the text."""

    shown: DataFrame
    found: DataFrame
    total: DataFrame


def search_links(links: DataFrame, user_id: str, text: str | None = None) -> SearchPage:
    """A search command: ask for ten links, show five."""
    query = (text or "").strip(C.WS_CHARS)
    result = S.search(links, user_id, query=query, limit=C.SEARCH_LIMIT)
    found = result.links.agg(F.count(F.lit(1)).alias("found"))
    return SearchPage(S.newest_first(result.links, C.SEARCH_SHOWN), found, result.total)


def search_links_all_users(links: DataFrame, text: str | None = None) -> DataFrame:
    """The same command for every user at once: shown rows with found and total."""
    query = (text or "").strip(C.WS_CHARS)
    found, totals = S.search_all_users(links, query=query, limit=C.SEARCH_LIMIT)
    counts = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("found"))
    return (
        found.filter(F.col("position") <= C.SEARCH_SHOWN)
        .join(counts, "user_id")
        .join(totals, "user_id")
    )


def _not_found(missing: Column, message: Column) -> list[Column]:
    return [
        F.when(missing, F.lit(C.CODE_NOT_FOUND)).alias("code"),
        F.when(missing, message).alias("message"),
        F.when(missing, F.lit(404)).otherwise(F.lit(200)).cast("long").alias("status"),
    ]


def get_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The link of each wanted id, or a not-found row.  wanted: id."""
    found = links.select(F.lit(True).alias("_found"), *LINK_VIEW)
    message = F.concat(F.lit(C.MSG_ID), F.col("id").cast("string"), F.lit(C.MSG_NOT_FOUND))
    joined = wanted.select("id").join(found, "id", "left")
    return joined.select(*LINK_VIEW, *_not_found(F.col("_found").isNull(), message))


def delete_links(links: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that stay, one row per wanted (id, user_id) with its outcome)."""
    message = F.concat(F.lit(C.MSG_ID), F.col("id").cast("string"), F.lit(C.MSG_NOT_OWNED))
    outcome = store.deleted(links, wanted)
    return store.delete(links, wanted), outcome.select(
        "id", "user_id", "deleted", *_not_found(~F.col("deleted"), message)
    )

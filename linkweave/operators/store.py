"""Upserts, deletes and ordered batches of save requests, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.functions.text import blank_to_null, trim_ws
from linkweave.schemas import LINKS
from linkweave.session import written

COLUMNS = LINKS.fieldNames()
CONTENT = ["title", "description", "tags", "manual_tags"]


def split_existing(requests: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests for links their user does not own yet, stored rows returned for the others).

    Stored rows come with the seq of the request they answer.
    """
    keys = ["url", "user_id"]
    new_work = requests.join(links.select(*keys), keys, "left_anti")
    returned = requests.select("seq", *keys).join(links, keys)
    return new_work, returned.select("seq", *COLUMNS)


def with_stored(rows: DataFrame, links: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """The rows with the `stored` link of their key, or null."""
    return rows.join(links.select(*key, F.struct(*COLUMNS).alias("stored")), list(key), "left")


def resolve_batch(requests: DataFrame, links: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """What an ordered batch leaves behind: one row per key, as if requests ran one by one.

    requests: seq, url, user_id, team_id, channel_id, requested_at and a `content` struct; none by
    a stored row's owner.  Result: the key, `first` (identity of a new row), `content`, changed_at and the
    `stored` row, null for a new key.

    The owner is the first saver; repeats by the owner change nothing, so the content is that of
    the last request by anybody else, or the first request's.  Requests collapse per (key, user)
    before the shuffle; then the two latest users of a key suffice, one of whom is not the owner.
    """
    by_user = [*key] if "user_id" in key else [*key, "user_id"]
    identity = F.struct("seq", "url", "user_id", "team_id", "channel_id", "requested_at")
    saved = F.struct("seq", "user_id", "requested_at", "content")
    users = requests.groupBy(*by_user).agg(
        F.min_by(F.struct(identity.alias("identity"), F.col("content").alias("content")), "seq").alias("earliest"),
        F.max_by(saved, "seq").alias("latest"),
    )
    users = written(users, "users")
    newest = W.partitionBy(*key).orderBy(F.desc("latest.seq"))
    oldest = W.partitionBy(*key).orderBy("earliest.identity.seq")
    ends = users.withColumn("_new", F.row_number().over(newest)).filter("_new <= 2").unionByName(
        users.withColumn("_new", F.row_number().over(oldest)).filter("_new = 1").withColumn("_new", F.lit(0))
    )
    per_key = ends.groupBy(*key).agg(
        F.min_by("earliest", F.col("earliest.identity.seq")).alias("earliest"),
        F.max_by("latest", F.when(F.col("_new") == 1, 1)).alias("last"),
        F.max_by("latest", F.when(F.col("_new") == 2, 1)).alias("before"),
    )
    owner = F.coalesce("stored.user_id", trim_ws(F.col("earliest.identity.user_id")))
    other = F.when(F.col("last.user_id") != owner, F.col("last")).otherwise(F.col("before"))
    return (
        with_stored(per_key, links, key)
        .withColumn("_other", other)
        .select(
            *key,
            F.col("earliest.identity").alias("first"),
            F.coalesce("_other.content", "earliest.content").alias("content"),
            F.coalesce("_other.requested_at", "earliest.identity.requested_at").alias("changed_at"),
            "stored",
        )
    )


def changed_rows(
    links: DataFrame, resolved: DataFrame, key: tuple[str, ...] = ("url",), highest_id: int | None = None
) -> DataFrame:
    """Full rows of everything the batch inserts or replaces.

    A replaced row keeps id, user, team, channel and created_at.  A new row gets its id from its place in the arrival
    order: the highest id ever given plus the distance from the first request.  Without `highest_id` the
    highest id of `links` counts, so a caller that deletes links must keep it.
    """
    resolved = written(resolved, "resolved")
    top = F.lit(highest_id) if highest_id is not None else links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")).scalar()
    start = resolved.agg(F.min("first.seq").alias("start")).scalar()
    is_old = F.col("stored").isNotNull()
    user, team, channel = (trim_ws(F.col(f"first.{c}")) for c in ("user_id", "team_id", "channel_id"))
    new = {
        "id": top + F.col("first.seq") - start + 1,
        "user_id": user,
        "team_id": F.coalesce(blank_to_null(team), user),
        "channel_id": channel,
        "is_private": F.lit(False),
        "created_at": F.col("first.requested_at"),
    }

    def column(name: str):
        if name in key:
            return F.col(name)
        if name in CONTENT:
            return F.col(f"content.{name}").alias(name)
        if name == "updated_at":
            return F.col("changed_at").alias(name)
        if name == "url":
            return F.coalesce("stored.url", "first.url").alias(name)
        return F.when(is_old, F.col(f"stored.{name}")).otherwise(new[name]).alias(name)

    return resolved.select(*[column(c) for c in COLUMNS])


def upsert(links: DataFrame, changed: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """Links with the changed rows put in place of those with the same key."""
    untouched = links.join(changed.select(*key), list(key), "left_anti")
    return untouched.select(*COLUMNS).unionByName(changed.select(*COLUMNS))


def save_batch(
    links: DataFrame, requests: DataFrame, key: tuple[str, ...] = ("url",), highest_id: int | None = None
) -> DataFrame:
    """Links after an ordered batch of requests with content."""
    return upsert(links, saved_rows(links, requests, key, highest_id), key)


def saved_rows(
    links: DataFrame, requests: DataFrame, key: tuple[str, ...] = ("url",), highest_id: int | None = None
) -> DataFrame:
    """What save_batch changes.  Only the stored rows with the batch's URLs take part, and are read once."""
    requests = written(requests, "requests")
    touched = written(links.join(requests.select("url").distinct(), "url", "left_semi").select(*COLUMNS), "touched")
    new_work, _ = split_existing(requests, touched)
    resolved = resolve_batch(new_work, touched, key)
    return written(changed_rows(links, resolved, key, highest_id), "changed")


def delete(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links without those named by (id, user_id); other users' links stay."""
    return links.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*links.columns)


def deleted(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (id, user_id) pairs with whether such a row existed."""
    present = links.select("id", "user_id", F.lit(True).alias("_present"))
    return wanted.join(present, ["id", "user_id"], "left").select(
        "id", "user_id", F.coalesce("_present", F.lit(False)).alias("deleted")
    )

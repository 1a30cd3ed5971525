"""Merging and renaming tags: an alias graph closed by pointer jumping, and the rewrite of the links that hold such tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.skew import hot_keys, join_split_hot
from linkweave.session import written
from linkweave.sources.links import LinkStore

#: Up to so many aliases are looked up in a map that goes along with the plan; more are joined.
MAPPED_ALIASES = 1000


def close_aliases(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tag, target) with the end of each chain, (tag, target) of those rejected because they lead into a cycle).

    Of several targets of a tag the first in order counts; a tag that is its own target is no alias.  Each round doubles the
    length of the steps, so a chain of n takes about log2(n) rounds, and so does a cycle to show: after that many
    steps as there are aliases, a tag that is not at an end leads into one.
    """
    once = aliases.where("tag is not null and target is not null and tag <> target").groupBy("tag").agg(F.min("target").alias("target"))
    start = written(once, "aliases")
    steps, reached, total = start, 1, start.count()
    while reached <= total:
        further = steps.select(F.col("tag").alias("target"), F.col("target").alias("_next"))
        jumped = written(steps.join(further, "target", "left").select("tag", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("_moved")), "aliases")
        moved = not jumped.where("_moved").isEmpty()
        steps, reached = jumped.select("tag", "target"), 2 * reached
        if not moved:
            break
    ends = steps.join(start.select(F.col("tag").alias("target")), "target", "left_anti").select("tag", "target")
    return ends, start.join(ends, "tag", "left_anti").select("tag", "target")


def renamed(links: DataFrame, closed: DataFrame) -> DataFrame:
    """The links that hold an aliased tag, with tags replaced; a tag that comes twice then stays at its first place.

    Only such links are rewritten.  A few aliases are looked up link by link, with nothing to shuffle; many are joined
    to the links' tags, of which hot ones are dealt out.
    """
    few = closed.limit(MAPPED_ALIASES + 1).collect()
    if len(few) <= MAPPED_ALIASES:
        to = F.create_map(*[F.lit(v) for r in few for v in (r["tag"], r["target"])]) if few else F.create_map().cast("map<string,string>")
        new = F.array_distinct(F.transform("tags", lambda t: F.coalesce(F.try_element_at(to, t), t)))
        return links.where(F.exists("tags", lambda t: F.map_contains_key(to, t))).withColumn("tags", new)
    exploded = links.select("id", F.posexplode("tags").alias("_place", "tag"))
    counts = exploded.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).join(closed.select("tag"), "tag", "left_semi")
    hit = join_split_hot(exploded, closed, ["tag"], hot_keys(counts, ["tag"], "n"), ["id"])
    changes = hit.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_place", "target"))).alias("_new"))
    tags = F.array_distinct(F.transform("tags", lambda t, i: F.coalesce(F.try_element_at("_new", i), t)))
    return links.join(changes, "id").withColumn("tags", tags).select(*links.columns)


def rename_tags(store: LinkStore, aliases: DataFrame, batch: int) -> DataFrame:
    """Merge and rename tags in a store as a batch of its own; returns the aliases rejected for leading into a cycle.

    The store's side table of tags by bucket says which buckets hold an aliased tag; no other is read.
    """
    closed, rejected = close_aliases(aliases)
    closed = written(closed, "aliases-closed")
    store.write_links(renamed(store.links_with_tags(closed.select("tag"), batch), closed), batch)
    store.refresh_usage(batch)
    return rejected

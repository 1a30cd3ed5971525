"""Tag usage and tag vocabularies, for all teams or users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.session import written


def team_tag_usage(links: DataFrame) -> DataFrame:
    """(team_id, tag_name, usage_count, last_used).  Counts combine before the shuffle."""
    return (
        links.select("team_id", "updated_at", F.explode("tags").alias("tag_name"))
        .groupBy("team_id", "tag_name")
        .agg(F.count(F.lit(1)).alias("usage_count"), F.max("updated_at").alias("last_used"))
    )


def popular_tags(usage: DataFrame, limit: int = C.POPULAR_LIMIT) -> DataFrame:
    """Each team's most used tags.  The limit is applied before and after the shuffle."""
    order = W.partitionBy("team_id").orderBy(F.desc("usage_count"), "tag_name")
    return (
        usage.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("team_id", "tag_name", "usage_count", F.col("position").cast("long").alias("position"))
    )


def user_tags(links: DataFrame, limit: int = C.SEED_TAG_LIMIT) -> DataFrame:
    """Each user's most frequent tags."""
    order = W.partitionBy("user_id").orderBy(F.desc("frequency"), "tag")
    return (
        links.select("user_id", F.explode("tags").alias("tag"))
        .groupBy("user_id", "tag")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("user_id", "tag", "frequency", F.col("position").cast("long").alias("position"))
    )


def _seeds_per_team(teams: DataFrame) -> DataFrame:
    seeds = F.array(*[F.lit(t) for t in C.SEED_TAGS])
    return teams.select("team_id").distinct().select("team_id", F.posexplode(seeds).alias("seed_pos", "tag"))


def existing_tags(usage: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """(team_id, tag, tag_rank): a team's tags by usage, then the seed tags it does not use yet.

    `teams` lists the teams to answer for, also ones without links; default: teams with usage.

    No task sorts a whole team: tags with equal usage and equal first letters form a block, an unused seed tag one of
    its own.  Blocks of a team are few and are numbered from their sizes; tags are numbered inside their block.
    """
    usage = written(usage.select("team_id", F.col("tag_name").alias("tag"), "usage_count"), "usage")
    wanted = usage.select("team_id").distinct() if teams is None else written(teams.select("team_id").distinct(), "teams")
    used = usage if teams is None else usage.join(wanted, "team_id", "left_semi")
    seeds = _seeds_per_team(wanted).withColumn("usage_count", F.lit(0).cast("long"))
    both = used.withColumn("seed_pos", F.lit(None).cast("int")).unionByName(seeds)
    tags = both.groupBy("team_id", "tag").agg(F.max("usage_count").alias("usage_count"), F.max("seed_pos").alias("seed_pos"))
    unused = F.col("usage_count") == 0
    letters = F.when(unused, F.lpad(F.col("seed_pos").cast("string"), 9, "0")).otherwise(F.substring("tag", 1, 3))
    tags = written(tags.select("team_id", "tag", "usage_count", letters.alias("_letters")), "vocabulary")
    block = ["team_id", "usage_count", "_letters"]
    earlier = W.partitionBy("team_id").orderBy(F.desc("usage_count"), "_letters").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        tags.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    inside = F.row_number().over(W.partitionBy(*block).orderBy("tag"))
    return (
        tags.withColumn("_inside", inside)
        .join(starts, block)
        .select("team_id", "tag", (F.col("_start") + F.col("_inside")).alias("tag_rank"))
    )


def team_seed_tags(usage: DataFrame, teams: DataFrame | None = None, limit: int = C.SEED_TAG_LIMIT) -> DataFrame:
    """The first `limit` existing tags of each team.

    A team with fewer tags than the limit has them all among its popular ones, and a team with
    more needs no seeds; so only popular tags take part.
    """
    teams = usage.select("team_id") if teams is None else teams
    top = popular_tags(usage, limit).select("team_id", F.col("tag_name").alias("tag"), F.col("position").alias("_i"))
    seeds = (
        _seeds_per_team(teams)
        .join(top.select("team_id", "tag"), ["team_id", "tag"], "left_anti")
        .select("team_id", "tag", (F.col("seed_pos") + limit + 1).cast("long").alias("_i"))
    )
    wanted = top.join(teams.select("team_id").distinct(), "team_id", "left_semi")
    order = W.partitionBy("team_id").orderBy("_i")
    return (
        wanted.unionByName(seeds)
        .withColumn("tag_rank", F.row_number().over(order).cast("long"))
        .filter(F.col("tag_rank") <= limit)
        .select("team_id", "tag", "tag_rank")
    )


def tag_listing(vocabulary: DataFrame) -> DataFrame:
    """Every team's tags in alphabetical order with the team's total."""
    totals = vocabulary.groupBy("team_id").agg(F.count(F.lit(1)).alias("total"))
    return vocabulary.join(totals, "team_id").select("team_id", "tag", "total").orderBy("team_id", "tag")

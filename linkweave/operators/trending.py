"""Trending tags: exponentially decayed use that adds up across batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HALF_LIFE_S = 7 * 24 * 3600
SCORE_DECIMALS = 6


def decayed_use(links: DataFrame, half_life_s: int = HALF_LIFE_S, sign: int = 1) -> DataFrame:
    """(team_id, tag, period, weight): use of each tag by half-life period, later uses weighing up to twice as much.

    A use `s` seconds into its period counts 2 ** (s / half life).  Weights of any sets of links add up (`merged`), and
    links that went are taken off with sign=-1; nothing depends on when the result is asked for.
    """
    seconds = F.unix_micros(F.col("updated_at").cast("timestamp")) / 1_000_000
    period = F.floor(seconds / half_life_s)
    use = F.pow(F.lit(2.0), (seconds - period * half_life_s) / half_life_s) * sign
    return (
        links.where("updated_at is not null")
        .select("team_id", F.explode("tags").alias("tag"), period.alias("period"), use.alias("weight"))
        .groupBy("team_id", "tag", "period").agg(F.sum("weight").alias("weight"))
    )


def merged(*parts: DataFrame) -> DataFrame:
    """The use of several batches together."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("team_id", "tag", "period").agg(F.sum("weight").alias("weight"))


def trending(parts: DataFrame, at: dt.datetime, k: int, half_life_s: int = HALF_LIFE_S) -> DataFrame:
    """(team_id, position, tag, score): each team's k tags of highest use, halved per half-life that has passed at an instant.

    Equal scores come by tag; scores have six decimals, and tags that round to nothing are left out.  The limit is applied before and after the
    shuffle.
    """
    now = F.unix_micros(F.lit(at).cast("timestamp")) / 1_000_000
    share = F.pow(F.lit(2.0), F.col("period") - now / half_life_s)
    scores = parts.groupBy("team_id", "tag").agg(F.round(F.sum(F.col("weight") * share), SCORE_DECIMALS).alias("score"))
    order = W.partitionBy("team_id").orderBy(F.desc("score"), "tag")
    ranked = scores.where("score > 0").withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("team_id", F.col("position").cast("long").alias("position"), "tag", "score")

"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# No more than this many keys are ever treated as hot, so their table may be broadcast.
MAX_HOT_KEYS = 10_000
# Rows that one task may get for a key: a larger key is split into so many of them.  Small inputs have none; the plan is the same.
MIN_HOT_ROWS = 1_000_000


def hot_keys(
    counts: DataFrame, keys: list[str], n: str, max_keys: int = MAX_HOT_KEYS, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Keys with more rows than total / max_keys, and how many ways to split each.

    Fewer than `max_keys` keys can pass that mark, whatever the data.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total")).scalar()
    return (
        counts.withColumn("_mark", F.greatest(F.lit(min_rows), F.ceil(total / F.lit(max_keys))))
        .filter(F.col(n) > F.col("_mark"))
        .select(*keys, F.ceil(F.col(n) / F.col("_mark")).cast("int").alias("_splits"))
    )


def join_split_hot(
    many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, spread_by: list[str]
) -> DataFrame:
    """Inner join where `many` may have hot keys: their rows are spread, and matching `few` rows copied.

    The hot table has fewer than MAX_HOT_KEYS rows by construction, which is why it is broadcast.
    """
    hot = F.broadcast(hot)
    spread = (
        many.join(hot, keys, "left")
        .withColumn(
            "_part",
            F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*spread_by), F.col("_splits").cast("long")).cast("int")
            ),
        )
        .drop("_splits")
    )
    copied = (
        few.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
        .drop("_splits")
    )
    return spread.join(copied, [*keys, "_part"]).drop("_part")

"""The seed vocabulary as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave import constants as C


def seed_tags(spark: SparkSession) -> DataFrame:
    """(tag_rank, tag) in fixed order."""
    return spark.createDataFrame(list(enumerate(C.SEED_TAGS, 1)), "tag_rank long, tag string")

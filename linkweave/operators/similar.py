"""Similar links by shared tags: a set-similarity join with weighted Jaccard."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.skew import hot_keys, join_split_hot
from linkweave.session import written

#: Least similarity as a fraction.
LEAST = (1, 2)
#: Weights are whole numbers, so that sums and comparisons are exact: thousandths of ln(1 + links / links with the tag).
MILLI = 1000
#: A team's tag, or a tag set, with more rows than this is dealt to several tasks.
HOT_ROWS = 100_000


def tag_sets(links: DataFrame) -> DataFrame:
    """(team_id, id, tags): each link's tags once, in order; links without tags are left out, and a null team counts as ''."""
    tags = F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))
    return links.select(F.coalesce("team_id", F.lit("")).alias("team_id"), "id", tags.alias("tags")).where(F.size("tags") > 0)


def similar_links(links: DataFrame, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the links of each team, by weighted Jaccard of their tags.

    Links of a team with equal tags form one set, named by its smallest id: members are (team_id, id, member_id) of the
    others.  Pairs are (team_id, id, other_id, similarity) of different sets that reach the least similarity, id the smaller.

    A set's tags are put in order, the heaviest and so rarest first.  Two similar sets share their first common tag
    among the first tags of both, those after which less weight is left than a similar set must share; only these tags are
    joined, so hot tags rarely are.  A pair is then looked at only if its total weights allow the similarity, which
    bands of weight make part of the join key, and if the weights from the common tag on do; the tags themselves are
    compared last, and each pair comes from its first common tag alone.
    """
    num, den = least
    team_set = ["team_id", "tags"]
    sets = written(tag_sets(links), "similar-links")
    classes = written(sets.groupBy(*team_set).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "similar-sets")
    hot_sets = hot_keys(classes, team_set, "n", min_rows=HOT_ROWS)
    every = join_split_hot(sets.withColumnRenamed("id", "member_id"), classes.drop("n"), team_set, hot_sets, ["member_id"])
    members = every.where("member_id <> id").select("team_id", "id", "member_id")

    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    exploded = classes.select("team_id", "id", "n", F.explode("tags").alias("tag"))
    counts = written(exploded.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")), "similar-tags")
    weights = counts.select("tag", F.round(MILLI * F.log(1 + F.lit(total) / F.col("n"))).cast("long").alias("weight"))
    hot_tags = hot_keys(counts, ["tag"], "sets", min_rows=HOT_ROWS)
    weighed = join_split_hot(exploded.drop("n"), weights, ["tag"], hot_tags, ["id"])
    items = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "tag")))
    ordered = weighed.groupBy("team_id", "id").agg(items.alias("items"), F.sum("weight").alias("total"))
    left = F.transform("items", lambda x, i: F.struct(
        x["tag"].alias("tag"), -F.aggregate(F.slice("items", i + 1, F.size("items")), F.lit(0).cast("long"), lambda a, y: a + y["minus"])))
    first = F.filter(left.cast("array<struct<tag:string,left:bigint>>"), lambda x: x["left"] * den >= F.col("total") * num)
    band = F.floor(F.log(F.col("total").cast("double")) / math.log(den / num)) if num < den else F.col("total")
    prefixes = written(
        ordered.select(
            "team_id", "id", "total", F.col("items.tag").alias("tags"),
            F.transform("items", lambda x: -x["minus"]).alias("weights"), F.explode(first).alias("p"), band.alias("band"),
        )
        .select("team_id", "id", "total", "tags", "weights", "p.tag", "p.left", "band"),
        "similar-prefixes",
    )
    key = ["team_id", "tag", "band"]
    many = prefixes.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("id", "total", "tags", "weights", "left")])
    many = many.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))  # a is the lighter one
    few = prefixes.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("id", "total", "tags", "left")])
    hot = hot_keys(many.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, "n", min_rows=HOT_ROWS)
    met = join_split_hot(many, few, key, hot, ["a_id"])
    lighter = (F.col("a_total") < F.col("b_total")) | ((F.col("a_total") == F.col("b_total")) & (F.col("a_id") < F.col("b_id")))
    may = (F.col("b_total") * num <= F.col("a_total") * den) & (
        F.least("a_left", "b_left") * (num + den) >= (F.col("a_total") + F.col("b_total")) * num
    )
    shared = F.filter(F.arrays_zip(F.col("a_tags").alias("a_tags"), F.col("a_weights").alias("a_weights")), lambda x: F.array_contains("b_tags", x["a_tags"]))
    weight = F.aggregate(shared, F.lit(0).cast("long"), lambda a, x: a + x["a_weights"])
    compared = met.where(lighter & may).where(F.get(F.array_intersect("a_tags", "b_tags"), F.lit(0)) == F.col("tag")).withColumn("both", weight)
    union = F.col("a_total") + F.col("b_total") - F.col("both")
    pairs = compared.where(F.col("both") * den >= union * num).select(
        "team_id", F.least("a_id", "b_id").alias("id"), F.greatest("a_id", "b_id").alias("other_id"), F.round(F.col("both") / union, 6).alias("similarity")
    )
    return pairs, members

"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import written


def _rank(column: str, turn: int) -> Column:
    """A vertex's place in the order of this turn; another order each turn keeps long chains from shrinking by one at a time."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(column)).alias("rank"), F.col(column).alias("vertex"))


def components(edges: DataFrame) -> DataFrame:
    """`vertex` and `root` for every vertex of the edges (`a`, `b`): equal roots for what is connected.

    Each turn every vertex joins the first of itself and its neighbours; edges are then renamed, and those inside a vertex go. Counts
    of edges alone come to the driver. Repeated edges, loops and no edges at all are fine; edges with a null end are left out.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    joined = []
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("vertex")).agg(F.min(_rank("b", turn)).alias("near"), F.min(_rank("a", turn)).alias("own"))
        moves = written(first.select("vertex", F.least("near", "own")["vertex"].alias("root")), "moves")
        joined.append(moves)
        left = left.join(moves.toDF("a", "new_a"), "a").join(moves.toDF("b", "new_b"), "b")
        left = left.where("new_a <> new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        left = written(left.distinct(), "edges")
        turn += 1
    if not joined:
        return left.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    found = joined[-1]
    for moves in reversed(joined[:-1]):
        further = found.select(F.col("vertex").alias("root"), F.col("root").alias("last"))
        found = moves.join(further, "root", "left").select("vertex", F.coalesce("last", "root").alias("root"))
    return found

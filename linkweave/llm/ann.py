"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours, a balanced partition of it, and a small classifier that learns from a vector which
part its neighbourhood lies in. The classifier puts every vector into its part and sends a query to its most probable
parts, as many as held-out sample queries need for the wished recall. What is found there is ranked by exact cosine.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from linkweave.llm.common import sampled, shipped
from linkweave.session import written

FIT_ROWS = 8_000
FIT_QUERIES = 500
GRAPH_NEIGHBOURS = 10
PART_ROWS = 2_000
PARTS = (8, 256)
BLOCK_ROWS = 20_000
RECALL = 0.96


def usable(vector: Column) -> Column:
    """Vectors that have a direction: no null, no component that is null or not finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(vectors: np.ndarray, count: int) -> np.ndarray:
    near = np.empty((len(vectors), count), np.int64)
    for start in range(0, len(vectors), 500):
        score = vectors[start : start + 500] @ vectors.T
        score[np.arange(len(score)), np.arange(start, start + len(score))] = -np.inf
        near[start : start + 500] = np.argpartition(-score, count - 1, axis=1)[:, :count]
    return near


def balanced_parts(vectors: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: seeds by direction, then moves to the part of most neighbours with room."""
    room = int(np.ceil(len(vectors) / parts * 1.05))
    centres = vectors[rng.choice(len(vectors), parts, replace=False)]
    for _ in range(8):
        part = (vectors @ centres.T).argmax(1)
        for p in np.unique(part):
            centres[p] = vectors[part == p].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    wish = vectors @ centres.T
    part = np.full(len(vectors), -1)
    size = np.zeros(parts, np.int64)
    for i in np.argsort(-wish.max(1)):
        part[i] = next(p for p in np.argsort(-wish[i]) if size[p] < room)
        size[part[i]] += 1
    for _ in range(5):
        moved = 0
        for i in rng.permutation(len(vectors)):
            votes = np.bincount(part[near[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and size[best] < room:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < len(vectors) // 200:
            break
    return part


class Router:
    """One hidden layer, trained on the sample: the chance that a vector's neighbours lie in each part."""

    def __init__(self, vectors: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, rounds: int = 30):
        parts = target.shape[1]
        self.weights = [rng.normal(0, np.sqrt(2 / vectors.shape[1]), (vectors.shape[1], hidden)), np.zeros(hidden),
                        rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(vectors))
            for start in range(0, len(order), 256):
                rows = order[start : start + 256]
                x = vectors[rows]
                inner = np.maximum(x @ self.weights[0] + self.weights[1], 0)
                slope = (self._softmax(inner @ self.weights[2] + self.weights[3]) - target[rows]) / len(rows)
                back = (slope @ self.weights[2].T) * (inner > 0)
                step += 1
                for w, (m, v), g in zip(self.weights, moments, (x.T @ back, back.sum(0), inner.T @ slope, slope.sum(0)), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        weights = np.exp(scores - scores.max(1, keepdims=True))
        return weights / weights.sum(1, keepdims=True)

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return self._softmax(np.maximum(vectors @ w[0] + w[1], 0) @ w[2] + w[3])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, seed: int = 7, recall: float = RECALL) -> dict[str, Any]:
    """Router and number of parts to visit, from at most about FIT_ROWS vectors; `rows` is how many the index will hold."""
    rng = np.random.default_rng(seed)
    vectors = unit(sample)
    parts = int(min(max(rows // PART_ROWS, PARTS[0]), PARTS[1], max(1, len(vectors) // 20)))
    if parts == 1:
        return {"router": None, "parts": 1, "visits": 1}
    near = neighbour_graph(vectors, min(GRAPH_NEIGHBOURS, len(vectors) - 1))
    part = balanced_parts(vectors, near, parts, rng)
    target = np.zeros((len(vectors), parts))
    np.add.at(target, (np.arange(len(vectors))[:, None], part[near]), 0.5 / near.shape[1])
    target[np.arange(len(vectors)), part] += 0.5
    # visits are set on queries whose neighbours the router has not learned from
    asked = rng.permutation(len(vectors))[: min(FIT_QUERIES, len(vectors) // 5)]
    learned = np.setdiff1d(np.arange(len(vectors)), asked)
    router = Router(vectors[learned], target[learned], rng)
    home = router.chances(vectors).argmax(1)
    order = np.argsort(-router.chances(vectors[asked]), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(rank, home[near[asked][:, :5]], axis=1).ravel()
    reached = np.array([(needed < visits).mean() for visits in range(1, parts + 1)])
    return {"router": router, "parts": parts, "visits": int(np.argmax(reached >= recall)) + 1}


def search(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, the id and `score` of the k nearest others found for each row where `queries` holds.

    Nearness is cosine in double precision; ties go to the smaller id. Rows without an id, vectors without a direction and those
    of a length other than the most frequent one take no part. Equal rows count once. Fewer candidates give fewer rows, none give no row.
    Equal vectors are one class with its k+1 smallest ids, all that a result can name, so that a vector that very many rows share costs no more than another.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    id_type = vectors.schema[id_column].dataType.simpleString()
    result = f"query_id {id_type}, rank int, {id_column} {id_type}, score double"
    if length is None:
        return spark.createDataFrame([], result)
    rows = written(rows.where(F.size("vector") == length["length"]).select("id", "vector", F.coalesce("asks", F.lit(False)).alias("asks")).distinct(), "ann-rows")
    smallest = Window.partitionBy("vector").orderBy("id")
    firsts = rows.select("id", "vector").distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    classes = firsts.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(classes.select(F.element_at("ids", 1).alias("class"), "vector", "ids"), "ann-classes")
    asked = rows.where("asks").select("id", "vector").join(classes.select("class", "vector"), "vector").select("id", "class")
    asked = written(asked, "ann-queries")

    sample = sampled(classes.select("class", "vector"), "class", FIT_ROWS, "ann").select("vector").toPandas()  # bounded by FIT_ROWS
    trained = fit(np.stack(sample["vector"]).astype(np.float64), classes.count())
    shared = shipped(spark, trained)

    def parts_of(column: pd.Series, count: int) -> list[list[int]]:
        if trained_router() is None:
            return [[0]] * len(column)
        chances = trained_router().chances(unit(np.stack(column).astype(np.float64)))
        return np.argsort(-chances, axis=1, kind="stable")[:, :count].tolist()

    def trained_router() -> Router | None:
        return shared()["router"]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def homes(column: pd.Series) -> pd.Series:
        return pd.Series(parts_of(column, 1))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def routes(column: pd.Series) -> pd.Series:
        return pd.Series(parts_of(column, shared()["visits"]))

    placed = written(classes.select("vector", "ids", F.col("class"), homes("vector")[0].alias("part")), "ann-index")
    blocks = placed.groupBy("part").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).alias("blocks"))  # one row a part: PARTS bounds them
    indexed = placed.join(F.broadcast(blocks), "part").select("part", F.pmod(F.xxhash64("class"), "blocks").alias("block"), "vector", "ids")
    probes = classes.join(asked.select("class").distinct(), "class").select("class", "vector", F.explode(routes("vector")).alias("part"))
    probes = probes.join(F.broadcast(blocks), "part").select("class", "vector", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def nearest(sought: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(sought) and len(held):
            there = np.stack(held["vector"]).astype(np.float64)
            norms = np.linalg.norm(there, axis=1)
            ids = held["ids"].tolist()
            for start in range(0, len(sought), 256):
                part = sought.iloc[start : start + 256]
                own = np.stack(part["vector"]).astype(np.float64)
                score = own @ (there / norms[:, None]).T
                keep = min(k + 4, score.shape[1])  # what rounding may have put just outside is ranked again
                top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                own_norm = np.linalg.norm(own, axis=1)
                for i, (query, chosen) in enumerate(zip(part["class"], top, strict=True)):
                    exact = np.einsum("ij,j->i", there[chosen], own[i]) / (norms[chosen] * own_norm[i])
                    found = sorted((-s, x) for s, c in zip(exact.tolist(), chosen, strict=True) for x in ids[c])[: k + 1]
                    out.append(pd.DataFrame({"class": query, "found": [x for _, x in found], "score": [-s for s, _ in found]}))
        return pd.concat(out) if out else pd.DataFrame({"class": [], "found": [], "score": []})

    found = probes.groupBy("part", "block").cogroup(indexed.groupBy("part", "block")).applyInPandas(nearest, f"class {id_type}, found {id_type}, score double")
    best = Window.partitionBy("class").orderBy(F.desc("score"), "found")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("class", "found", "score")
    ranked = Window.partitionBy("id").orderBy(F.desc("score"), "found")
    named = asked.join(found, "class").where(F.col("id") != F.col("found")).withColumn("rank", F.row_number().over(ranked))
    return named.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("found").alias(id_column), "score")

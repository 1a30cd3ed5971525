"""Embedding whitening from an exact covariance by polarisation.

Components are scaled and rounded down to whole numbers.  The fit list holds each distinct vector once; n is its length and
S the sums per dimension.  A first pass gives n and S.  A second one adds up squared centred values, per dimension and per
sum of two dimensions: with z = n*x - S, var(z_i + z_j) - var(z_i) - var(z_j) = 2 cov(z_i, z_j).  To keep squares small a
task centres by the rounded-down mean m, y = x - m; since z = n*y - r with r = S - n*m, the sum of z squared is n*n*(sum of y
squared) - n*r*r, exactly.  The covariance is so known as fractions; only its entries are rounded, once, for eigh.

Vectors that are null or hold a null, NaN or infinite component are left out.  Vectors of other lengths, the empty one
included, count as filled up with zeros to the longest length.  Repeated rows count once in the fit and are each answered.
A component without variance (one distinct vector, or fewer than dimensions) has a null in `whitened`.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.whole_vectors import CHUNK_ROWS, column_totals, matrix, whole_vectors, widened
from linkweave.session import written

SCALE = 256
COMPONENTS = 4


@dataclass
class Whitening:
    """`n` distinct vectors with `sums` per dimension; `values` falling, `vectors[:, k]` of length one; shares of the trace."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def centre(self) -> tuple[list[int], list[int]]:
        """The mean of each dimension rounded down, and what is left of its sum."""
        whole = [s // self.n for s in self.sums]
        return whole, [s - self.n * m for s, m in zip(self.sums, whole, strict=True)]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        whole, left = self.centre()
        centred = (x - np.array(whole, np.int64)).astype(float) - np.array([r / self.n for r in left])
        scales = np.array([np.sqrt(v) if v > 0 else np.nan for v in self.values])
        return centred @ self.vectors[:, : len(self.values)] / scales


def covariance(rows: DataFrame, width: int, largest: int, n: int, sums: list[int]) -> list[list[Fraction]]:
    """The exact covariance matrix of distinct rows, divisor n, from squares of centred values and of their pair sums."""
    whole = [s // n for s in sums]
    left = [s - n * m for s, m in zip(sums, whole, strict=True)]
    mean = np.array(whole, np.int64)
    bound = CHUNK_ROWS * (4 * largest + 4) ** 2

    def squares(x: np.ndarray) -> np.ndarray:
        y = widened(x - mean, bound)
        alone = (y * y).sum(axis=0)
        pairs = [((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(axis=0) for i in range(width)]
        return np.concatenate([alone, *pairs])

    total = column_totals(rows, width, squares)
    centred = lambda square, rest: n * n * square - n * rest * rest
    out = [[Fraction(0)] * width for _ in range(width)]
    alone = [centred(total[i], left[i]) for i in range(width)]
    place = width
    for i in range(width):
        out[i][i] = Fraction(alone[i], n**3)
        for j in range(i + 1, width):
            both = centred(total[place], left[i] + left[j])
            out[i][j] = out[j][i] = Fraction(both - alone[i] - alone[j], 2 * n**3)
            place += 1
    return out


def principal(exact: list[list[Fraction]], n: int, sums: list[int], components: int) -> Whitening:
    """Eigenvectors of the covariance by falling eigenvalue; the largest entry of each is positive."""
    width = len(exact)
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]).reshape(width, width))
    order = np.argsort(-values, kind="stable")[:components]
    chosen = vectors[:, order] * np.where(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] < 0, -1.0, 1.0) if width else vectors
    trace = float(sum((exact[i][i] for i in range(width)), Fraction(0)))
    nothing = trace * width * np.finfo(float).eps
    kept = [float(v) if v > nothing else 0.0 for v in values[order]]
    return Whitening(n, sums, kept, chosen, [v / trace if trace else None for v in kept])


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    good = [k for k, v in enumerate(model.values) if v > 0]
    if not good:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(good) + 1, len(good)))
        for batch in batches:
            w = model.project(matrix(batch.column(0), width))[:, good]
            total += np.vstack([w.sum(axis=0, keepdims=True), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["position", "value"])

    sums = rows.select("x").mapInArrow(moments, "position int, value double").groupBy("position").agg(F.sum("value").alias("value"))
    found = np.array([r["value"] for r in sums.orderBy("position").collect()]).reshape(len(good) + 1, len(good)) / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(len(good))).max())


def _whitened(rows: DataFrame, width: int, largest: int, model: Whitening) -> DataFrame:
    whole, left = model.centre()
    mean, rest = np.array(whole, np.int64), np.array(left, object)
    bound = max(1, width) * (model.n * (2 * largest + 2)) ** 2
    schema = rows.select("_id").schema.add("whitened", T.ArrayType(T.DoubleType())).add("deviation", T.DecimalType(38, 0))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(start, CHUNK_ROWS)
                x = matrix(some.column(1), width)
                z = model.n * widened(x - mean, bound) - (rest if bound >= 2**62 else rest.astype(np.int64))
                far = pa.array([Decimal(int(v)) for v in (z * z).sum(axis=1)], pa.decimal128(38, 0))
                w = [[None if np.isnan(v) else v for v in row] for row in model.project(x).tolist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(w, pa.list_(pa.float64())), far], names=["_id", "whitened", "deviation"])

    return rows.select("_id", "x").mapInArrow(answer, schema)


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS
) -> tuple[DataFrame, Whitening | None]:
    """(one row per kept vector: id, `whitened` array of components, `deviation`; the model, None without rows).

    `deviation` is the sum over dimensions of (n*x - S) squared, exact.  The driver holds the covariance, whose size is
    that of a vector squared, and no row.
    """
    rows, width, largest = whole_vectors(vectors, vector_column, scale, "whitening-vectors", _id=id_column)
    fit = written(rows.select("x").distinct(), "whitening-distinct")
    first = column_totals(fit, width, lambda x: np.r_[len(x), widened(x, CHUNK_ROWS * (largest + 1)).sum(axis=0)])
    if not first:
        return _empty(rows, id_column), None
    n, sums = first[0], first[1:]
    model = principal(covariance(fit, width, largest, n, sums), n, sums, components)
    model.identity_error = identity_error(fit, width, model)
    return _whitened(rows, width, largest, model).withColumnRenamed("_id", id_column), model


def _empty(rows: DataFrame, id_column: str) -> DataFrame:
    nothing = rows.where(F.lit(False))
    return nothing.select(F.col("_id").alias(id_column), F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("decimal(38,0)").alias("deviation"))

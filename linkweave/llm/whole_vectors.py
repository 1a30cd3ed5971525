"""Vectors as whole numbers, for operators that compute without rounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import written

CHUNK_ROWS = 4096
#: Products of whole numbers stay in 64 bits below this; above it Python's unbounded numbers are used.
SAFE = 2**62


def whole_vectors(vectors: DataFrame, vector_column: str, scale: int, name: str, **columns: str) -> tuple[DataFrame, int, int]:
    """(rows with `x` = floor(scale * component) as array<bigint>, longest length, largest component), written once.

    `columns` gives the columns to carry, new name = old name.  Vectors that are null or hold a null, NaN or infinite
    component are left out; an empty vector stays.  Components must lie below 2**62 / scale in size.
    """
    c = F.col("_vector")
    read = vectors.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()], F.col(f"`{vector_column}`").cast("array<double>").alias("_vector"))
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = read.where(c.isNotNull() & finite)
    rows = written(kept.select(*columns, F.transform(c, lambda v: F.floor(v * F.lit(float(scale)))).alias("x")), name)
    size = rows.agg(
        F.max(F.size("x")).alias("width"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least")
    ).first()
    largest = max(abs(size["most"] or 0), abs(size["least"] or 0))
    if largest >= SAFE:
        raise ValueError(f"components must lie below 2**62 / {scale} in size")
    return rows, size["width"] or 0, largest


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of int64, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def widened(values: np.ndarray, bound: int) -> np.ndarray:
    """The same numbers, unbounded ones where a result may reach `bound` and that leaves 64 bits."""
    return values if bound < SAFE else values.astype(object)


def column_totals(rows: DataFrame, width: int, totals: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Sums over all rows of what `totals` gives for a matrix of some of them, exactly.

    Each task sends one number per position, however many rows it has read; the sums are made by Spark, and only
    they, one per position, come to the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), width)
            for start in range(0, len(x), CHUNK_ROWS):
                found = np.asarray(totals(x[start : start + CHUNK_ROWS])).astype(object)
                total = found if total is None else total + found
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["position", "value"])

    sums = rows.select("x").mapInArrow(partial, "position int, value decimal(38,0)").groupBy("position").agg(F.sum("value").alias("value"))
    return [int(r["value"]) for r in sorted(sums.collect(), key=lambda r: r["position"])]

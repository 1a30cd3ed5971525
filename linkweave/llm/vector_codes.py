"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

All numbers are whole: components are scaled and rounded down, codebooks are learned by k-means whose means are rounded
down, and distances are exact.  The nearest entry is found in the Walsh-Hadamard domain: parts and entries are filled up
with zeros to a power of two D, transformed by additions alone, and their coefficients put in order of sequency (number of
sign changes), which brings most of the difference to the front.  The sum of squared differences of all coefficients is D
times the squared distance; the sum of some of them is never more.  So an entry whose sum so far passes the whole sum of
another entry cannot be nearest and goes, without rounding and without a chance to lose a tie.

Vectors that are null or hold a null, NaN or infinite component are left out.  Vectors of other lengths, the empty one
included, count as filled up with zeros to the longest length, and that to a multiple of the number of parts.  Repeated rows
each count, and each is answered.  The codebooks start from the distinct smallest ids, null last; of several
vectors with one id the least counts.  With fewer ids there are fewer entries.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.whole_vectors import CHUNK_ROWS, SAFE, column_totals, matrix, whole_vectors
from linkweave.operators.skew import hot_keys, join_split_hot
from linkweave.session import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A label with more rows than this is answered by several tasks.
HOT_LABEL_ROWS = 100_000


@dataclass
class Codebooks:
    """`entries[part, entry, position]`, whole numbers that stand for `scale` times a component."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        """SHA-256 of all numbers in order, as text with commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: bytes) -> list[float]:
        """The vector that a code stands for."""
        return (np.concatenate([self.entries[p, c] for p, c in enumerate(codes)]) / self.scale).tolist()


def sequency_order(size: int) -> list[int]:
    """Places of the plain transform's coefficients by number of sign changes: the Gray code, its bits reversed."""
    bits = size.bit_length() - 1
    return [int(f"{k ^ (k >> 1):0{bits}b}"[::-1], 2) if bits else 0 for k in range(size)]


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, by sequency; rows are filled up with zeros to a power of two."""
    n, width = rows.shape
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, size), rows.dtype)
    out[:, :width] = rows
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part the index of its nearest entry, the lowest of equal ones, and the squared distance."""
    t, e = walsh(parts), walsh(entries)
    (n, size), k = t.shape, len(e)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    first = (t[:, :1] - e[None, :, 0]) ** 2
    sums = first.ravel()
    rival = first.argmin(axis=1)
    bound = ((t - e[rival]) ** 2).sum(axis=1)
    done = 1
    while True:
        left = sums <= bound[row]
        row, entry, sums = row[left], entry[left], sums[left]
        if done == size:
            break
        upto = min(size, 2 * done)
        sums = sums + ((t[row, done:upto] - e[entry, done:upto]) ** 2).sum(axis=1)
        done = upto
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == least[row])
    best = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
    return entry[best], least // size


def _parts(x: np.ndarray, n_parts: int) -> np.ndarray:
    width = -(-x.shape[1] // n_parts) * n_parts
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), n_parts, width // n_parts)


def _assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = _parts(x, len(entries))
    found = [nearest(parts[:, p], entries[p]) for p in range(len(entries))]
    return parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _start(rows: DataFrame, width: int, n_parts: int, n_entries: int) -> np.ndarray:
    ids = rows.select(F.col("_id").alias("_first")).distinct().orderBy(F.asc_nulls_last("_first")).limit(n_entries)
    chosen = rows.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_first").agg(F.min("x").alias("x"))
    first = [r["x"] for r in chosen.orderBy(F.asc_nulls_last("_first")).collect()]
    x = np.array([v + [0] * (width - len(v)) for v in first], np.int64).reshape(len(first), width)
    return _parts(x, n_parts).transpose(1, 0, 2)


def _learn(rows: DataFrame, width: int, entries: np.ndarray, rounds: int) -> np.ndarray:
    n_parts, k, size = entries.shape
    for _ in range(rounds):

        def sums(x: np.ndarray, entries: np.ndarray = entries) -> np.ndarray:
            parts, index, _ = _assigned(x, entries)
            out = np.zeros((n_parts, k, size + 1), np.int64)
            for p in range(n_parts):
                for entry in range(k):
                    mine = parts[index[:, p] == entry, p]
                    out[p, entry, :size], out[p, entry, size] = mine.sum(axis=0), len(mine)
            return out.ravel()

        total = column_totals(rows, width, sums)
        means = [[v // group[-1] for v in group[:-1]] if group[-1] else None for group in (total[i : i + size + 1] for i in range(0, len(total), size + 1))]
        entries = np.array([m if m is not None else entries[i // k, i % k].tolist() for i, m in enumerate(means)], np.int64).reshape(entries.shape)
    return entries


def _coded(rows: DataFrame, width: int, entries: np.ndarray) -> DataFrame:
    carried = rows.select("_id", "_label", "x")
    schema = carried.drop("x").schema.add("code", "binary").add("error", "long")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(start, CHUNK_ROWS)
                _, index, distance = _assigned(matrix(some.column(2), width), entries)
                codes = pa.array([bytes(c) for c in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), codes, pa.array(distance.sum(axis=1), pa.int64())], names=["_id", "_label", "code", "error"]
                )

    return carried.mapInArrow(coded, schema)


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = SCALE,
    n_parts: int = PARTS,
    n_entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """(one row per kept vector: id, `label`, `code` of one byte a part, `error`, `label_error`; the codebooks).

    `error` is the squared distance to what the code stands for, `label_error` its sum over all rows with an equal label,
    null included.  A round reads the rows once and sends each task's sums, so the driver sees parts x entries x width
    numbers and no row.  At most 256 entries.
    """
    rows, width, largest = whole_vectors(vectors, vector_column, scale, "codes-vectors", _id=id_column, _label=label_column)
    size = 1 << max(0, -(-width // n_parts) - 1).bit_length()
    if 4 * largest * largest * size * size * n_parts >= SAFE or n_entries > 256:
        raise ValueError("components are too large for exact distances in 64 bits, or there are more than 256 entries")
    entries = _learn(rows, width, _start(rows, width, n_parts, n_entries), rounds)
    coded = written(_coded(rows, width, entries).withColumn("_key", F.struct("_label")), "codes-rows")
    sums = written(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    hot = hot_keys(sums, ["_key"], "n", min_rows=HOT_LABEL_ROWS)
    joined = join_split_hot(coded, sums.drop("n"), ["_key"], hot, ["_id"])
    found = joined.select(F.col("_id").alias(id_column), F.col("_label").alias("label"), "code", "error", "label_error")
    return found, Codebooks(entries, scale)

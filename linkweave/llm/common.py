"""Small helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE_SCALE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def sampled(rows: DataFrame, id_column: str, bound: int, salt: str) -> DataFrame:
    """About `bound` rows, or all if there are no more: those whose hashed id lies below a share of the range.

    Only for fitting a classifier or calibrating it on labelled rows. Counting reads no text.
    """
    share = min(1.0, bound / max(1, rows.count()))
    if share >= 1:
        return rows
    point = F.pmod(F.xxhash64(F.lit(salt), F.col(id_column)), F.lit(SAMPLE_SCALE))
    return rows.where(point < int(share * SAMPLE_SCALE))


def shipped(spark: SparkSession, thing: Any, keep: bool = False) -> Callable[[], Any]:
    """A broadcast of something that holds this package's classes; tasks call the result and need no installed copy of them.

    With `keep`, a Python worker's next tasks get the same object, with what the last one has added to it, as long as it has the broadcast.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    held: list[Any] = []

    def unpack() -> Any:
        if keep:  # the worker keeps its broadcasts between tasks
            if not hasattr(packed, "unpacked"):
                packed.unpacked = pickle.loads(packed.value)
            return packed.unpacked
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]

    return unpack


def chunks(texts: list[Any], max_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts together have about `max_chars` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > max_chars:
            yield start, i
            start = i
            size = 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

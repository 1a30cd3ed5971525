"""Session helpers: the shared scratch folder and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only for local sessions that name none."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    if not hasattr(spark, "_linkweave_dir"):
        spark._linkweave_dir = tempfile.mkdtemp(prefix="run-")
    return spark._linkweave_dir


class _Scopes(threading.local):
    """Open scratch scopes; each stream saves its batches in a thread of its own."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at the end; what is to stay must be saved before."""
    _scopes.open.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _scopes.open.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Used where a result is expensive, or not repeatable, and is read more than once: a lost
    executor then costs a re-read, not a re-run.
    """
    path = f"{shared_dir(df.sparkSession)}/linkweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

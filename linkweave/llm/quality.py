"""Quality by hierarchical empirical Bayes: a text's own evidence, combined with what its host and path are known for.

A small classifier gives each text a chance of being good. Sums of these chances by path, host and over all give posteriors:
a path is shrunk toward its host and a host toward the whole, the more so the fewer texts it has. How strongly follows
from how much hosts, and paths within hosts, differ. A text's odds are then moved by the odds of its path against the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.common import sampled, shipped
from linkweave.session import written

LABELLED_ROWS = 20_000  # labelled texts that the classifier is fitted on
BINS = 16
STRENGTH = (2.0, 1_000.0)  # texts that a prior may weigh
KEEP = 0.5

_KINDS = np.full(256, 5, np.int64)  # letters above ASCII count as lower case
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"()-?", b"")):
    _KINDS[list(_chars)] = _name
_KINDS[[b for b in range(33, 127) if _KINDS[b] == 5]] = 6
_KINDS[[b for b in range(32) if _KINDS[b] == 5]] = 6
EDGES = re.compile(r"^\W+|\W+$")


def features(text: str | None) -> list[float]:
    """Shape and repetition of a text; shares, so that length matters in its own feature only."""
    raw = (text or "").encode()
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = raw.split(b"\n")
    counted = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = Counter(word[-1] for word in words)
    marked = sum(count for byte, count in ends.items() if _KINDS[byte] == 6)
    exclaimed = ends.get(ord("!"), 0)
    alone = sum(count for word, count in counted.items() if not word.isalnum() and len(word) < 3 and word.isascii())
    stops = sum(ends.get(x, 0) for x in b".?")
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = counted.most_common(3)
    return [
        kinds[0] + kinds[5], kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], marked / n, exclaimed / n, alone / n, stops / n, doubled / n,
        len(counted) / n**0.8, pairs / max(1, n - 1), top[0][1] / n if top else 1.0, sum(c for _, c in top) / n, len(raw) / n,
        len(set(lines)) / len(lines), min(1.0, len(lines) / n), float(np.log1p(n)),
    ]


class Evidence:
    """Logistic model over quantile bins of the features; no labels of both classes leave only the share of good texts."""

    def __init__(self, table: np.ndarray, good: np.ndarray, rounds: int = 400):
        self.good = (good.sum() + 1) / (len(good) + 2)
        self.fitted = 0 < good.sum() < len(good)
        if not self.fitted:
            return
        shares = np.linspace(0, 1, BINS + 1)[1:-1]
        # edges between quantiles of each class, so that a rare class has bins of its own
        self.edges = [np.unique(np.concatenate([np.quantile(column[good == c], shares) for c in (0, 1)])) for column in table.T]
        self.sizes = [len(edges) + 1 for edges in self.edges]
        cells = self._cells(table)
        self.weights = np.zeros(sum(self.sizes))
        self.base = np.log(self.good / (1 - self.good))
        sums = np.zeros_like(self.weights)
        for _ in range(rounds):
            slope = self._sigmoid(self._logit(cells)) - good
            step = np.zeros_like(self.weights)
            np.add.at(step, cells, slope[:, None].repeat(cells.shape[1], 1))
            step = step / len(good) + 2e-4 * self.weights
            sums += step**2
            self.weights -= 0.3 * step / (np.sqrt(sums) + 1e-6)
            self.base -= 0.3 * slope.mean()

    def _cells(self, table: np.ndarray) -> np.ndarray:
        starts = np.cumsum([0, *self.sizes[:-1]])
        return np.stack([np.searchsorted(e, column, side="right") + s for e, column, s in zip(self.edges, table.T, starts, strict=True)], 1)

    def _logit(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(1) + self.base

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def chances(self, table: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(table), self.good)
        return np.clip(self._sigmoid(self._logit(self._cells(table))), 1e-4, 1 - 1e-4)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Evidence:
    """The classifier, from about LABELLED_ROWS labelled texts; rows without an id or label are left out."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.select(id_column, F.col(label_column).cast("int").alias("good")).dropDuplicates([id_column])
    known = sampled(known, id_column, LABELLED_ROWS, "quality")
    texts = docs.select(id_column, F.col(text_column).alias("text")).join(F.broadcast(known), id_column)  # LABELLED_ROWS bounds it

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "shape", "good"])

    rows = sorted(texts.mapInArrow(shape, "doc_id long, shape array<double>, good int").collect(), key=lambda r: (r["doc_id"], r["shape"]))
    if not rows:
        return Evidence(np.zeros((0, 1)), np.zeros(0))
    return Evidence(np.array([r["shape"] for r in rows]), np.array([float(r["good"]) for r in rows]))


def with_evidence(docs: DataFrame, model: Evidence, text_column: str) -> DataFrame:
    """All columns and `evidence`, the classifier's chance that the text is good."""
    shared = shipped(docs.sparkSession, model)
    at = docs.columns.index(text_column)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = [features(text) for text in batch.column(at).to_pylist()]
            chance = shared().chances(np.array(table)) if table else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64())], [*batch.schema.names, "evidence"])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField("evidence", T.DoubleType())]))


def _strength(groups: DataFrame, mean: Column, within: str) -> DataFrame:
    """How many texts the prior weighs: from the variance of the groups' means beyond what their texts' own variance explains."""
    spread = F.greatest(F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2) / F.sum("n"), F.lit(0.0))
    noise = F.sum(F.greatest(F.col("squares") - F.col("good") ** 2 / F.col("n"), F.lit(0.0))) / F.sum("n") * F.count(F.lit(1)) / F.sum("n")
    share = F.sum("good") / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-9))
    return groups.agg(F.least(F.greatest(share * (1 - share) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias(within), share.alias(f"{within}_mean"))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """`host`, `path`, `host_posterior`, `path_posterior` and `prior` from (host, path, evidence) rows.

    Sums combine before each shuffle, so a host with a third of all texts costs no more than another.
    """
    chance = F.col("evidence")
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(chance).alias("good"), F.sum(chance * chance).alias("squares"))
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    of_hosts = _strength(hosts, F.lit(prior), "strength").first()["strength"] or STRENGTH[1]
    hosts = hosts.select("host", ((F.col("good") + of_hosts * prior) / (F.col("n") + of_hosts)).alias("host_posterior"))
    joined = paths.join(hosts, "host")
    of_paths = _strength(joined, F.col("host_posterior"), "strength").first()["strength"] or STRENGTH[1]
    posterior = (F.col("good") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)
    return joined.select("host", "path", "host_posterior", posterior.alias("path_posterior"), F.lit(float(prior)).alias("prior"))


def site_of(source: Column, section: Column) -> tuple[Column, Column]:
    """Host and path of a source: what stands before the first slash, and the source up to its last slash with the section."""
    site = F.coalesce(source.cast("string"), F.lit(""))
    folder = F.regexp_replace(site, r"/[^/]*$", "")
    return F.substring_index(site, "/", 1), F.concat_ws("/", folder, F.coalesce(section.cast("string"), F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          section_column: str = "lang") -> DataFrame:
    """All columns of `docs` and `evidence`, `host_posterior`, `path_posterior`, `quality` (0 to 1) and `good` (quality of 0.5 or more).

    Texts that are null or empty have the shape of an empty text. Rows without a source are one host, without a section one path. Rows
    with equal or null ids are each judged. Without labels of both classes the evidence is the same for all. Columns already called
    like the results are replaced.
    """
    model = train(docs, labels, id_column, text_column)
    added = ["evidence", "host_posterior", "path_posterior", "prior", "quality", "good"]
    kept = [c for c in docs.columns if c not in added]
    host, path = site_of(F.col(source_column), F.col(section_column))
    sites = with_evidence(docs.select(F.col(text_column).alias("text"), host.alias("host"), path.alias("path")), model, "text")
    sites = written(site_posteriors(sites.select("host", "path", "evidence")), "quality-sites").withColumnsRenamed({"host": "site_host", "path": "site_path"})
    rows = with_evidence(docs.select(*kept), model, text_column)
    rows = rows.join(sites, (host == F.col("site_host")) & (path == F.col("site_path")), "left")
    odds = lambda x: F.log(x / (1 - x))
    logit = odds(F.col("evidence")) + odds(F.col("path_posterior")) - odds(F.col("prior"))
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-logit)))
    return rows.select(*kept, "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= KEEP).alias("good"))

"""Corpus pipeline: quality classifier, line dedup, near-duplicate removal, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again for the next one. All but
the last return the columns of their input; null and empty texts, repeated rows, empty tables and further columns go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import bpe, decontaminate, line_dedup, quality, simhash
from linkweave.llm.common import table
from linkweave.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("good").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts; `n_chars` follows. A document stays, even with no line left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = line_dedup.dedup_lines(docs, carried=others)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays. Rows without an id cannot be told apart; all stay."""
    groups = simhash.near_duplicates(docs)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: `doc_id`, `ids` (packed 32-bit little-endian), their number and digest, and the digest of the text decoded again."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("encode", encode),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

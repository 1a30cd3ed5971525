"""Word and substring postings of links on disk, kept up batch by batch.

Every batch adds folders.  A posting counts as long as no later batch names its link, so an update writes only the links it
changes.  Postings lie in buckets by a hash of their word or substring, as many as the batch's size asks, so a search
reads only the buckets of what it asks for, and inside a file Parquet's statistics lead to the rows.  Ids and places are
coded as distances in bytes of seven bits, before they are shuffled.  Writing a batch again replaces only its own folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.postings import GRAM_SCHEMA, WORD_SCHEMA, gram_postings, indexed_text, read_grams, read_words, word_postings

INITIAL = -1
#: Characters of text that make up one bucket, and the most buckets of a batch.
BUCKET_CHARS = 8_000_000
MOST_BUCKETS = 4096
VERSIONS = "id long, user_id string, length int, deleted boolean, batch long"
STATS = "links long, words long, buckets int, batch long"
PLACES = "batch long, of int, bucket int"
TABLES = ("words", "grams")


class TextIndex:
    """Postings, the version of every indexed link, and totals per batch under one folder.

    `words` and `grams` say which postings are kept.  Links have unique ids; rows without an id are not indexed.
    """

    def __init__(self, spark: SparkSession, path: str, words: bool = True, grams: bool = True):
        self.spark, self.path, self.kinds = spark, path.rstrip("/"), [k for k, on in zip(TABLES, (words, grams), strict=True) if on]

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def create(self, links: DataFrame) -> None:
        """Start an index from a links table."""
        self._write(links, None, INITIAL, 0, 0)

    def update(self, changed: DataFrame, batch: int, deleted: DataFrame | None = None) -> None:
        """Take in a batch's new and changed links, and the ids of deleted ones (column id)."""
        before = self.totals(batch)
        ids = changed.select("id") if deleted is None else changed.select("id").unionByName(deleted.select("id"))
        gone = self.versions(batch).join(ids.distinct(), "id", "left_semi").agg(
            F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")
        ).first()
        self._write(changed, deleted, batch, before["links"] - gone["links"], before["words"] - gone["words"])

    def compact(self, links: DataFrame, path: str) -> TextIndex:
        """An index of the current links in a new folder, as one batch."""
        new = TextIndex(self.spark, path, *[k in self.kinds for k in TABLES])
        new.create(links)
        return new

    def _write(self, links: DataFrame, deleted: DataFrame | None, batch: int, n_before: int, words_before: int) -> None:
        text = indexed_text(links).where("id is not null")
        length = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))
        rows = text.select("id", "user_id", length.cast("int").alias("length"), F.lit(False).alias("deleted"), F.length("text").alias("chars"))
        if deleted is not None:
            gone = deleted.select("id", F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("int").alias("length"), F.lit(True).alias("deleted"), F.lit(0).alias("chars"))
            rows = rows.unionByName(gone)
        rows.sortWithinPartitions("id").write.mode("overwrite").parquet(self._folder("versions", batch))
        added = self.spark.read.schema("length int, deleted boolean, chars int").parquet(self._folder("versions", batch)).where("not deleted").agg(
            F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")
        ).first()
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * BUCKET_CHARS < added["chars"]:
            buckets *= 2
        for kind in self.kinds:
            made, key = (word_postings(links), "term") if kind == "words" else (gram_postings(links), "gram")
            placed = made.withColumn("of", F.lit(buckets)).withColumn("bucket", self._bucket(F.col(key), F.lit(buckets)))
            laid = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
            laid.write.mode("overwrite").partitionBy("of", "bucket").parquet(self._folder(kind, batch))
        totals = self.spark.range(1).select(
            F.lit(n_before + added["links"]).cast("long").alias("links"), F.lit(words_before + added["words"]).cast("long").alias("words"), F.lit(buckets).alias("buckets")
        )
        totals.coalesce(1).write.mode("overwrite").parquet(self._folder("stats", batch))

    @staticmethod
    def _bucket(key: Column, of: Column) -> Column:
        return F.pmod(F.xxhash64(key), of.cast("long")).cast("int")

    def totals(self, before: int | None = None) -> dict[str, int]:
        """Number of links and words after the last batch, or after the last one before a batch."""
        stats = self._table("stats", STATS)
        last = (stats if before is None else stats.where(F.col("batch") < before)).orderBy(F.desc("batch")).first()
        return {"links": last["links"], "words": last["words"]}

    def versions(self, before: int | None = None) -> DataFrame:
        """(id, user_id, length) of the links that are indexed now, or just before a batch."""
        every = self._table("versions", VERSIONS)
        every = every if before is None else every.where(F.col("batch") < before)
        last = every.groupBy("id").agg(F.max_by(F.struct("user_id", "length", "deleted"), "batch").alias("v"))
        return last.where("not v.deleted").select("id", "v.user_id", "v.length")

    def _live(self, postings: DataFrame) -> DataFrame:
        """Postings whose link no later batch names."""
        later = self._table("versions", VERSIONS).where(F.col("batch") > INITIAL)
        if later.isEmpty():
            return postings.drop("batch")
        last = later.groupBy("id").agg(F.max("batch").alias("_last"))
        return postings.join(last, "id", "left").where(F.col("_last").isNull() | (F.col("batch") == F.col("_last"))).drop("_last", "batch")

    def _asked(self, kind: str, schema: str, key: str, wanted: list[str]) -> DataFrame:
        """Rows of the wanted words or substrings, from their buckets only."""
        rows = self._table(kind, f"{schema}, {PLACES}")
        places = reduce(lambda a, b: a | b, [F.col("bucket") == self._bucket(F.lit(w), F.col("of")) for w in wanted], F.lit(False))
        return rows.where(places & F.col(key).isin(wanted))

    def blocks(self, terms: list[str]) -> DataFrame:
        """(term, block, most, shortest) of the given words; links of earlier versions count, so these are bounds."""
        asked = self._asked("words", WORD_SCHEMA, "term", terms)
        return asked.groupBy("term", "block").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))

    def postings(self, terms: list[str], positions: bool = False, blocks: DataFrame | None = None) -> DataFrame:
        """(term, id, n, length, and positions if asked) of the given words, one row per link; only from the given blocks, if any."""
        asked = self._asked("words", WORD_SCHEMA, "term", terms)
        return self._live(read_words(asked if blocks is None else asked.join(blocks, "block", "left_semi"), positions))

    def grams(self, wanted: list[str]) -> DataFrame:
        """(gram, id, fields) of the given substrings, one row per link; bits of `fields` say where it is held."""
        return self._live(read_grams(self._asked("grams", GRAM_SCHEMA, "gram", wanted)))

"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

Exact part: a log of (key, document, +1 or -1), from which references per key are counted. Fast part: one cuckoo filter a
shard with the keys that two or more documents hold. A line that its filter does not know is kept without a look at the exact
table; the others are verified there. Inserting and deleting documents changes the log and just those filters whose keys become
shared, or stop being so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.session import written

BLANKS = " \t\n\x0b\x0c\r"
MIN_POINTS = 10
SHARD_KEYS = 250_000  # shared keys that a shard's filter is made for
SPLIT_ROWS = 100_000  # lines that one task holds against a filter
SLOTS, MAX_KICKS, FULL = 4, 500, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard long, table binary"


class CuckooFilter:
    """A set of 64-bit hashes with 16-bit fingerprints, four slots a bucket; never forgets a member, may know others too."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, members: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, members) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, packed: bytes) -> CuckooFilter:
        return cls(np.frombuffer(packed, np.uint16).reshape(-1, SLOTS).copy())

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = hashes.astype(np.int64).view(np.uint64)
        mark = ((bits >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = ((bits >> np.uint64(24)) & np.uint64(len(self.table) - 1)).astype(np.int64)  # low bits name the shard
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(hashes)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there is no room; the filter must then be made anew from the exact table."""
        if len(hashes) + np.count_nonzero(self.table) > FULL * self.table.size:
            return False
        for mark, first, second in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            if not (self._put(first, mark) or self._put(second, mark) or self._kick(second, mark)):
                return False
        return True

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def _kick(self, bucket: int, mark: int) -> bool:
        for kick in range(MAX_KICKS):
            slot = (kick + mark) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(self._step(np.array([mark], np.uint16))[0])
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Only for members: one fingerprint each goes."""
        for mark, *places in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in places:
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        room = len(hashes)
        while not (made := cls.sized(room)).insert(hashes):
            room *= 2
        return made


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id` and `key` (MD5 of the line key), once for each long enough key of each document with an id."""
    lines = F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)
    long_enough = F.filter(F.transform(lines, line_key), lambda key: F.char_length(key) >= MIN_POINTS)
    keys = F.array_distinct(F.transform(long_enough, F.md5))
    return (
        docs.where(F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("doc_id"), F.explode(keys).alias("hex"))
        .select("doc_id", F.unhex("hex").alias("key"))
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """One filter for each shard that has shared keys. A shard holds about SHARD_KEYS of them, whatever the data."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        table = CuckooFilter.of(group["hash"].to_numpy()).table
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "table": [table.tobytes()]})

    return shared.select(_shard(shards).alias("shard"), F.xxhash64("key").alias("hash")).groupBy("shard").applyInPandas(build, FILTERS)


def references(entries: DataFrame) -> DataFrame:
    """Per key: rows that hold it, smallest and largest document. Counts combine before the shuffle, so hot keys do no harm."""
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def probe(entries: DataFrame, filters: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The entries whose key their shard's filter knows: all shared ones, and a few others.

    `load` has `shard` and `entries`: how many entries a shard has. A shard with many, as a hot line makes it, is split by
    document, and its filter goes to each split.
    """
    parts = load.select("shard", (F.floor(F.col("entries") / SPLIT_ROWS) + 1).alias("parts"))
    held = filters.join(parts, "shard").select("shard", "table", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = entries.withColumn("shard", _shard(shards)).join(F.broadcast(parts), "shard")  # one small row for SHARD_KEYS keys
    rows = rows.select("doc_id", "key", "shard", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))

    def known(lines: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if tables.empty or lines.empty:
            return lines.iloc[:0][["doc_id", "key"]]
        hit = CuckooFilter.read(tables["table"].iloc[0]).knows(lines["hash"].to_numpy())
        return lines.loc[hit, ["doc_id", "key"]]

    rows = rows.withColumn("hash", F.xxhash64("key"))
    ids = entries.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInPandas(known, f"doc_id {ids}, key binary")


def keep_lines(docs: DataFrame, dropped: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """Per row of `docs`: the id, the `carried` columns, `n_lines`, `n_dropped` and `kept`, its text without the lines whose key is dropped from that document."""
    marks = dropped.groupBy(F.col("doc_id").alias("marked_id")).agg(F.collect_set("key").alias("marks"))
    others = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)]
    rows = docs.select(F.col(text_column).alias("row_text"), F.col(id_column).alias("row_id"), *others)
    rows = rows.join(marks, F.col("row_id") == F.col("marked_id"), "left").drop("marked_id")
    lower = str.maketrans(UPPER, LOWER)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for text, marked in zip(batch.column(0).to_pylist(), batch.column(len(carried) + 2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                left = lines
                if marked:
                    marked = set(marked)
                    stay = lambda line, gone=marked: hashlib.md5(line.strip(BLANKS).translate(lower).encode()).digest() not in gone
                    left = [line for line in lines if stay(line)]
                out.append((len(lines), len(lines) - len(left), "\n".join(left)))
            n_lines, n_dropped, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())],
                [id_column, *carried, "n_lines", "n_dropped", "kept"],
            )

    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return rows.mapInArrow(kept, T.StructType([*docs.select(id_column, *carried).schema.fields, *counts, T.StructField("kept", T.StringType())]))


class LineIndex:
    """Lines of all inserted documents in a shared folder; documents can be taken out again.

    `entries/` is the exact log, one folder a batch; `filters/` holds the filters after each batch. A batch names itself, and a
    batch that is written again replaces itself, so a repeated run changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def _read(self, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/entries/{x}" for x in batches))

    def live(self, batches: list[str]) -> DataFrame:
        """`key` and `doc_id` of what is in the index after these batches."""
        left = self._read(batches).groupBy("key", "doc_id").agg(F.sum("change").alias("held"))
        return left.where("held > 0").select("key", "doc_id")

    def shared(self, batches: list[str]) -> DataFrame:
        """Keys that two or more documents hold after these batches, with exact counts."""
        return references(self.live(batches)).where("first_doc < last_doc")

    def insert(self, docs: DataFrame, batch: str, earlier: list[str]) -> None:
        """Add documents that the index does not hold yet."""
        self._write(line_keys(docs).distinct().withColumn("change", F.lit(1)), batch, earlier)

    def delete(self, doc_ids: DataFrame, batch: str, earlier: list[str]) -> None:
        """Take documents out; `doc_ids` has their `doc_id`. Lines they alone kept from being the first come back elsewhere."""
        gone = self.live(earlier).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        self._write(gone.withColumn("change", F.lit(-1)), batch, earlier)

    def _write(self, entries: DataFrame, batch: str, earlier: list[str]) -> None:
        entries.select("key", "doc_id", "change").write.mode("overwrite").parquet(f"{self.path}/entries/{batch}")
        touched = self._read([batch]).select("key").distinct()
        before = self._shared_of(touched, earlier) if earlier else touched.limit(0)
        after = self._shared_of(touched, [*earlier, batch])
        changes = after.join(before, "key", "left_anti").select("key", F.lit(1).alias("change")).unionByName(
            before.join(after, "key", "left_anti").select("key", F.lit(-1).alias("change"))
        )
        filters = self.filters(earlier[-1]) if earlier else self.spark.createDataFrame([], FILTERS)
        changes = changes.select(_shard(self.shards).alias("shard"), F.xxhash64("key").alias("hash"), "change")

        def updated(held: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
            if changed.empty:
                return held
            added = changed.loc[changed["change"] > 0, "hash"].to_numpy()
            table = CuckooFilter.read(held["table"].iloc[0]) if len(held) else CuckooFilter.sized(len(added))
            table.delete(changed.loc[changed["change"] < 0, "hash"].to_numpy())
            full = not table.insert(added)
            shard = held["shard"].iloc[:1] if len(held) else changed["shard"].iloc[:1]
            return pd.DataFrame({"shard": shard, "table": [None if full else table.table.tobytes()]})

        new = written(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(updated, FILTERS), "line-filters")
        full = new.where("table IS NULL").select("shard")
        again = self.shared([*earlier, batch]).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
        rebuilt = build_filters(again.select("key"), self.shards)
        new.where("table IS NOT NULL").unionByName(rebuilt).write.mode("overwrite").parquet(f"{self.path}/filters/{batch}")

    def _shared_of(self, touched: DataFrame, batches: list[str]) -> DataFrame:
        return references(self.live(batches).join(touched, "key", "left_semi")).where("first_doc < last_doc").select("key")

    def filters(self, batch: str) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters/{batch}")

    def dropped(self, docs: DataFrame, batches: list[str]) -> DataFrame:
        """`doc_id` and `key` of the lines that inserted documents lose, after these batches."""
        entries = line_keys(docs)
        load = entries.groupBy(_shard(self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("entries"))
        return verified(probe(entries, self.filters(batches[-1]), load, self.shards), self.shared(batches))


def verified(entries: DataFrame, shared: DataFrame) -> DataFrame:
    """Of what the filters know, what the exact table confirms: another document with a smaller id holds the key."""
    firsts = shared.select("key", "first_doc")
    return entries.join(firsts, "key").where(F.col("doc_id") > F.col("first_doc")).select("doc_id", "key")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """Drop each line whose key an earlier document holds: the id, the `carried` columns, `n_lines`, `n_dropped` and `kept` (the text left).

    Keys under 10 code points never count. A null or empty text is one empty line. Rows with the same id are one document, each row
    being kept; a row without an id keeps all its lines and lends none. Only the named columns are read.
    """
    entries = written(line_keys(docs, id_column, text_column), "line-entries")
    shared = written(references(entries).where("first_doc < last_doc"), "line-references")
    shards = 1 + shared.count() // SHARD_KEYS
    load = entries.groupBy(_shard(shards).alias("shard")).agg(F.count(F.lit(1)).alias("entries"))
    candidates = probe(entries, build_filters(shared, shards), load, shards)
    return keep_lines(docs, verified(candidates, shared), id_column, text_column, carried)

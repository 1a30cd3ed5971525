"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code is perfect: each 23-bit word has one
codeword within three bits. Words that differ in one bit share the codeword of one of them among the codewords of the other
and its neighbours: six at most. If two fingerprints differ in three bits or fewer, then either one segment is equal and one
of the others differs in one bit at most, or all three differ in one bit each, and one half of the last is equal. Each case gives
join keys of 30 to 35 bits; what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.graph import components
from linkweave.session import written

SHINGLE = 3
SEED = 42
MAX_BITS = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GENERATOR = 0b101011100011  # of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, length
HALF = 9


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of the word shingles, repeats counted; 0 if there is no word."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(piece, SEED) for piece in pieces), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and `bits`, the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(text) for text in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], [id_column, "bits"])

    rows = docs.select(id_column, text_column)
    return rows.mapInArrow(compute, T.StructType([rows.schema[0], T.StructField("bits", T.LongType())]))


class Golay:
    """Decodes 23-bit words to the index (12 bits) of their codeword."""

    def __init__(self):
        low = np.array([self._remainder(x) for x in range(1 << 12)])
        high = np.array([self._remainder(x << 12) for x in range(1 << 11)])
        self._parts = low, high
        self._errors = np.zeros(1 << 11, np.int64)
        ones = [1 << i for i in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    error = ones[a] | ones[b] | ones[c]  # one, two or three bits
                    self._errors[self._remainder(error)] = error

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    def index(self, words: np.ndarray) -> np.ndarray:
        low, high = self._parts
        return (words ^ self._errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Each word's codeword index and those of its one-bit neighbours, as (row, index) without repeats."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        indices = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        new = np.concatenate([np.ones((len(words), 1), bool), indices[:, 1:] != indices[:, :-1]], axis=1)
        row, column = np.nonzero(new)
        return row, indices[row, column]


def join_keys(bits: np.ndarray, golay: Golay) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) for both sides of the join: near codewords on the left, the own codeword on the right."""
    values = [(bits.view(np.uint64) >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64) for first, size in SEGMENTS]
    own = [golay.index(value) for value in values]
    near = [golay.near(value, size) for value, (_, size) in zip(values, SEGMENTS, strict=True)]
    every = np.arange(len(bits))
    left, right = [], []
    case = 0
    for equal in range(3):
        for other in range(3):
            if equal != other:
                row, index = near[other]
                left.append((row, case << 40 | values[equal][row] << 12 | index))
                right.append((every, case << 40 | values[equal] << 12 | own[other]))
                case += 1
    for half in range(2):
        equal_half = values[2] >> (HALF * half) & ((1 << HALF) - 1)
        row, index = near[0]
        left.append((row, case << 40 | index << 21 | own[1][row] << 9 | equal_half[row]))
        row, index = near[1]
        right.append((row, case << 40 | own[0][row] << 21 | index << 9 | equal_half[row]))
        case += 1
    gather = lambda side: tuple(np.concatenate([x[i] for x in side]) for i in range(2))
    return gather(left), gather(right)


def keyed(distinct: DataFrame) -> DataFrame:
    """`side` (0 left, 1 right), `key` and `bits` for each distinct fingerprint: 66 rows at most."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(bits), 2000):
                part = np.ascontiguousarray(bits[start : start + 2000])
                for side, (row, key) in enumerate(join_keys(part, golay)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), side, np.int8)), pa.array(key), pa.array(part[row])], ["side", "key", "bits"])

    return distinct.select("bits").mapInArrow(expand, "side byte, key long, bits long")


def close(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def classes(distinct: DataFrame) -> DataFrame:
    """`bits` and `root` of all distinct fingerprints that link to another one.

    First each bucket's members meet its smallest right-hand member only, so a bucket of any size gives one row a member. Then
    only members that the links so far leave in another component than that centre meet the rest of their bucket. Inside a
    cloud of near copies most members are joined by then, and no pair of them is ever made. No link between components is lost.
    """
    keys = written(keyed(distinct), "simhash-keys")
    left, right = keys.where("side = 0").select("key", "bits"), keys.where("side = 1").select("key", "bits")
    centres = right.groupBy("key").agg(F.min("bits").alias("centre"), F.count(F.lit(1)).alias("members"))
    met = written(left.join(centres, "key").where("members > 1 OR bits <> centre"), "simhash-met")
    links = met.where(close("bits", "centre")).select(F.col("bits").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()
    links = written(links, "simhash-links")
    roots = written(components(links), "simhash-roots").select(F.col("vertex").alias("bits"), "root")

    # buckets with several right-hand members: whoever isn't joined to the centre yet is held against all of them
    several = met.where("members > 1").select("key", "centre", "bits").join(roots, "bits", "left").select(
        "key", "bits", "centre", F.coalesce("root", "bits").alias("root")
    )
    centre_roots = roots.toDF("centre", "centre_root")
    lefts = several.join(centre_roots, "centre", "left").select("key", "bits", "root", F.coalesce("centre_root", "centre").alias("centre_root"))
    more = right.join(centres.where("members > 1").select("key", "centre"), "key").join(centre_roots, "centre", "left")
    rights = more.join(roots, "bits", "left").select(
        "key", "bits", F.coalesce("root", "bits").alias("root"), F.coalesce("centre_root", "centre").alias("centre_root")
    )
    lefts, rights = written(lefts, "simhash-lefts"), written(rights, "simhash-rights")
    pairs = None
    for a, b in ((lefts.where("root <> centre_root"), rights), (lefts.where("root = centre_root"), rights.where("root <> centre_root"))):
        a = a.select("key", F.col("bits").alias("a"), F.col("root").alias("a_root"))
        b = b.select("key", F.col("bits").alias("b"), F.col("root").alias("b_root"))
        found = a.join(b, "key").where((F.col("a_root") != F.col("b_root")) & close("a", "b")).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
    return components(links.unionByName(pairs.distinct())).select(F.col("vertex").alias("bits"), "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `bits` and `component_id`, the smallest id of all documents that links of three bits or fewer reach.

    Null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Rows with equal ids are each kept; ids that
    are null are never the smallest, unless a component has no other. Only the two named columns are read.
    """
    marked = written(fingerprints(docs, id_column, text_column), "simhash-bits")
    firsts = written(marked.groupBy("bits").agg(F.min(id_column).alias("first_id")), "simhash-firsts")
    roots = classes(firsts.select("bits"))
    grouped = firsts.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = grouped.join(smallest, "root").select("bits", "component_id")
    return marked.join(labels, "bits").select(id_column, "bits", "component_id")

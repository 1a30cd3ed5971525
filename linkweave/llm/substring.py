"""Substring dedup with one compressed FM-index a shard.

Windows of equal words share their minimizer, the run of SEED words with the smallest hash. So each text is cut into segments of
neighbouring windows with one minimizer, and only segments that share theirs with another one can hold a repeated window.
Equal segments are counted as one. Different segments of one minimizer go to one shard, which indexes them (suffix sorting,
wavelet matrix) and looks each window up by backward search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.common import chunks
from linkweave.session import written

WINDOW = 35
SEED = 8
SHARD_WORDS = 300_000
#: Different segments of one minimizer that a shard takes; the windows of larger groups are counted by their hashes.
GROUP_SEGMENTS = 4_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
POSITION_BITS = 30

SEGMENT_COLUMNS = ["text_hash", "start", "windows", "minimizer", "h1", "h2"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at space and \t to \r


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(29))


class WordRun:
    """The words of several texts as 64-bit hashes, with range hashes of any of their runs."""

    def __init__(self, texts: list[list[bytes]]):
        known: dict[bytes, int] = {}
        ids = [known.setdefault(word, len(known)) for words in texts for word in words]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(word) for word in known), np.uint64, len(known))
        self.words = hashes[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
        self.ends = np.cumsum([len(words) for words in texts]) if texts else np.zeros(0, np.int64)
        self._sums = []

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two hashes of words[start:end]; equal for equal words, wherever they stand."""
        if not self._sums:
            for base in BASES:
                powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.words), base)]))
                inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.words), np.uint64(pow(int(base), -1, 1 << 64)))]))
                sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mixed(self.words ^ base) * powers[:-1])])
                self._sums.append((sums, inverse))
        length = (end - start).astype(np.uint64)
        return [mixed((sums[end] - sums[start]) * inverse[start] + length) for sums, inverse in self._sums]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: number of its text, first word, number of windows, minimizer."""
        n = len(self.words)
        empty = np.zeros(0, np.int64)
        if n < WINDOW:
            return empty, empty, empty, empty.astype(np.uint64)
        grams = np.zeros(n - SEED + 1, np.uint64)
        for i in range(SEED):
            grams = grams * BASES[0] + self.words[i : n - SEED + 1 + i]
        grams = mixed(grams)
        # smallest hash, then rightmost: both follow from the window's own words
        place = np.uint64((1 << POSITION_BITS) - 1) - np.arange(len(grams), dtype=np.uint64)
        least = (grams >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | place
        span, width = WINDOW - SEED + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (np.uint64((1 << POSITION_BITS) - 1) - (least & np.uint64((1 << POSITION_BITS) - 1))).astype(np.int64)
        text = np.searchsorted(self.ends, np.arange(len(at)), side="right")
        inside = np.arange(len(at)) + WINDOW <= self.ends[np.minimum(text, len(self.ends) - 1)]
        start_of = np.flatnonzero(inside)
        if not len(start_of):
            return empty, empty, empty, empty.astype(np.uint64)
        new = np.concatenate([[True], (np.diff(start_of) > 1) | (np.diff(at[start_of]) != 0) | (np.diff(text[start_of]) != 0)])
        first = start_of[new]
        count = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
        return text[first], first, count, grams[at[first]]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def segments_of(rows: DataFrame) -> DataFrame:
    """All segments of the texts in (doc_id, text_hash, text) rows, with 128-bit hashes of their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(2).to_pylist()]
            for start, end in chunks(texts):
                run = WordRun([words_of(text) for text in texts[start:end]])
                text, first, count, minimizer = run.segments()
                hashes = run.range_hashes(first, first + count + WINDOW - 1) if len(first) else [np.zeros(0, np.uint64)] * 2
                begins = np.concatenate([[0], run.ends[:-1]])
                own = pa.array(text + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(first - begins[text] if len(text) else first),
                     pa.array(count), signed(minimizer), *map(signed, hashes)], ["doc_id", *SEGMENT_COLUMNS])

    fields = [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in SEGMENT_COLUMNS)]
    return rows.mapInArrow(cut, T.StructType(fields))


class WaveletMatrix:
    """Packed bits by level; `occurrences` counts a symbol in a prefix."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def occurrences(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of both prefix ends among the symbols equal to each given one, counted from where its run begins."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level & 1).astype(bool)
            start, end = self._step(i, bit, start), self._step(i, bit, end)
        return start, end

    def _step(self, i: int, bit: np.ndarray, place: np.ndarray) -> np.ndarray:
        block, rest = place >> 6, (place & 63).astype(np.uint64)
        ones = self.ranks[i][block] + np.bitwise_count(self.bits[i][block] & ((np.uint64(1) << rest) - np.uint64(1)))
        return np.where(bit, self.zeros[i] + ones, place - ones)


class FMIndex:
    """Backward search over integer symbols from 1; 0 parts the texts."""

    def __init__(self, text: np.ndarray):
        self.size = int(text.max()) + 1
        order = np.argsort(text, kind="stable")
        rank = text.astype(np.int64)
        reach = 1
        while reach < 2 * WINDOW:  # longer common prefixes need no order: no pattern is longer than a window
            after = np.concatenate([rank[reach:], np.full(min(reach, len(rank)), -1, np.int64)])[: len(rank)] + 1
            key = rank * (len(text) + self.size + 1) + after
            order = np.argsort(key, kind="stable")
            changed = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
            rank = np.empty(len(text), np.int64)
            rank[order] = changed
            reach *= 2
        self.before = WaveletMatrix(text[order - 1], self.size)
        self.first = np.searchsorted(np.sort(text), np.arange(self.size + 1))
        every = np.arange(self.size)
        self.origin = self.before.occurrences(every, np.zeros_like(every), np.zeros_like(every))[0]
        self.length = len(text)

    def extend(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol and go on as those of the given rows."""
        low, high = self.before.occurrences(symbol, start, end)
        base = self.first[symbol] - self.origin[symbol]
        return low + base, high + base


def repeated_windows(segments: list[np.ndarray], wanted: np.ndarray) -> list[np.ndarray]:
    """For each wanted segment, which of its windows occur twice or more in all of the given segments."""
    lengths = np.array([len(x) for x in segments])
    _, symbols = np.unique(np.concatenate(segments), return_inverse=True)
    text = np.zeros(len(symbols) + len(segments), np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(segments)), lengths)] = symbols + 1
    index = FMIndex(text)
    windows = lengths - WINDOW + 1
    found = [np.zeros(windows[i], bool) for i in wanted]
    at = np.zeros(len(wanted), np.int64)
    active = np.flatnonzero(windows[wanted] > 0)
    while len(active):
        ends = begins[wanted[active]] + at[active] + WINDOW
        low, high = np.zeros(len(active), np.int64), np.full(len(active), index.length, np.int64)
        matched = np.zeros(len(active), np.int64)
        left = np.arange(len(active))
        for step in range(1, WINDOW + 1):
            low[left], high[left] = index.extend(text[ends[left] - step], low[left], high[left])
            matched[left] = step
            left = left[high[left] - low[left] >= 2]
            if not len(left):
                break
        for i in left:
            found[active[i]][at[active[i]]] = True
        # the last words matched occur once, and so does any window that holds all of them
        move = np.where(high - low >= 2, 1, WINDOW - matched + 1)
        at[active] += move
        active = active[at[active] < windows[wanted[active]]]
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_hash`, `begin`, `end`: words covered by repeated windows, from (doc_id, text_hash, text) rows."""
    ids = docs.schema["doc_id"]
    where = ["doc_id", "text_hash"]
    segments = written(segments_of(docs), "substring-segments")
    several = segments.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("minimizer")
    several = written(several, "substring-several")  # so that a hot minimizer's segments can be split in the join
    shared = written(segments.join(several, "minimizer"), "substring-shared")
    content = ["minimizer", "h1", "h2", "windows"]
    distinct = shared.groupBy(*content).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*where, "start")).alias("at"))
    distinct = written(distinct.select(*content, "times", "at.*"), "substring-distinct")

    # equal segments: all their windows are repeated
    equal = distinct.where("times > 1").select("minimizer", "h1", "h2")
    ranges = shared.join(equal, ["minimizer", "h1", "h2"]).select(
        *where, F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("end")
    )

    # different segments with one minimizer
    groups = distinct.groupBy("minimizer").agg(F.count(F.lit(1)).alias("different"), F.min("times").alias("least")).where("different > 1 AND least = 1")
    total = distinct.join(groups, "minimizer").agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    shards = 1 + total // SHARD_WORDS
    wanted = distinct.join(groups.select("minimizer", (F.col("different") > GROUP_SEGMENTS).alias("large")), "minimizer")
    asked = wanted.groupBy(*where).agg(F.collect_list(F.struct("start", "windows", "minimizer", "times", "large")).alias("asked"))
    texts = docs.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})  # equal rows: all their segments have times > 1
    texts = texts.join(asked, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    texts = texts.select(*where, "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                run = WordRun([words_of(batch.column(2)[row].as_py())])
                out: list[tuple] = []
                for x in batch.column(3)[row].as_py():
                    step = 1 if x["large"] else x["windows"]
                    for start in range(x["start"], x["start"] + x["windows"], step):
                        piece = run.words[start : start + step + WINDOW - 1]
                        if x["large"]:
                            h1, h2 = (int(h.view(np.int64)[0]) for h in run.range_hashes(np.array([start]), np.array([start + WINDOW])))
                            out.append((start, x["times"], None, h1, h2, None))
                        else:
                            out.append((start, x["times"], x["minimizer"], None, None, piece.tobytes()))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    own = pa.array(np.full(len(out), row))
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *columns],
                        [*where, "start", "times", "minimizer", "h1", "h2", "words"],
                    )

    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "start", "times", "minimizer", "h1", "h2")]
    fetched = written(texts.mapInArrow(fetch, T.StructType([ids, *longs, T.StructField("words", T.BinaryType())])), "substring-words")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.frombuffer(x, np.uint64) for x in group["words"]]
        wanted = np.flatnonzero(group["times"].to_numpy() == 1)
        out = []
        for i, flags in zip(wanted, repeated_windows(pieces, wanted), strict=True):
            row = group.iloc[i]
            out += [(row["doc_id"], row["text_hash"], row["start"] + a, row["start"] + b - 1 + WINDOW) for a, b in zip(*_runs(flags), strict=True)]
        return pd.DataFrame(out, columns=[*where, "begin", "end"])

    found_schema = f"doc_id {ids.dataType.simpleString()}, text_hash long, begin long, end long"
    small = fetched.where("words IS NOT NULL").select(F.pmod(F.xxhash64("minimizer"), F.lit(shards)).alias("shard"), *where, "start", "times", "words")
    ranges = ranges.unionByName(small.groupBy("shard").applyInPandas(search, found_schema))

    # minimizers with very many different segments: their windows are counted by hash, wherever they stand
    single = fetched.where("words IS NULL")
    often = single.groupBy("h1", "h2").agg(F.sum("times").alias("n")).where("n > 1").select("h1", "h2")
    more = single.where("times = 1").join(often, ["h1", "h2"])
    return ranges.unionByName(more.select(*where, F.col("start").alias("begin"), (F.col("start") + WINDOW).alias("end")))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `n_words`, `n_removed` and `kept` (the words left, one space between them) of each whole text.

    A word goes if a window of 35 words covers it whose words start anywhere else too, in the same text included. Null, empty and short
    texts lose nothing of themselves. Rows with equal or null ids are each kept and each count. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    ranges = repeated_ranges(rows).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    joined = rows.join(ranges, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values
            begin, end = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            out: list[tuple[int, int, str]] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                left = words
                part = slice(ends[row], ends[row + 1])
                if part.start < part.stop:
                    edges = np.bincount(begin[part], minlength=len(words) + 1) - np.bincount(end[part], minlength=len(words) + 1)
                    left = [words[i] for i in np.flatnonzero(edges[:-1].cumsum() == 0)]
                out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            n_words, n_removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                [id_column, "n_words", "n_removed", "kept"],
            )

    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType([docs.select(id_column).schema[0], *counts, T.StructField("kept", T.StringType())])
    return joined.select("doc_id", "text", "ranges").mapInArrow(keep, schema)

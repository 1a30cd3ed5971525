"""Benchmark decontamination: BM25 over the test items, pruned by block maxima, verified by overlap with question and answer.

An item is indexed as a whole and, where they are long enough to say something alone, as its question and as its answer. Every text
is cut into overlapping passages; each passage asks the index for all parts whose BM25 score reaches the part's threshold. The
threshold is the least score that a passage with enough of the part's shingles can have, so retrieval loses nothing. Blocks of
parts whose maxima already stay below are never scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.common import chunks, shipped
from linkweave.session import written

SHINGLE = 5
OVERLAP = 0.8
QUESTION_WORDS, ANSWER_WORDS = 8, 13  # shorter questions and answers count only as a part of the whole item
GATHERED = 2_000_000  # block maxima added up at once
K1, B = 1.2, 0.75
BLOCK_PARTS = 4
SHARD_ITEMS, SHARD_CHARS = 1_000, 4_000_000  # items of one index; each batch of texts asks all indexes in turn
WORDS = re.compile(r"\w+")
SENTENCES = re.compile(r"(?<=[.?!])\s+")
ROUNDING = 1e-3

LEAK = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def fullest(leak: dict) -> tuple:
    return -leak["overlap"], leak["item_id"]


class Vocabulary(dict):
    """Numbers of the items' words; any other word has the last number."""

    def __missing__(self, word: str) -> int:
        return -1


def shingles(words: list[int]) -> set[tuple[int, ...]]:
    """Runs of five words; fewer words make one run."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of both; the last sentence is the answer, a single one is all question."""
    sentences = SENTENCES.split(text.strip())
    cut = len(sentences) - 1 if len(sentences) > 1 else 1
    return WORDS.findall(" ".join(sentences[:cut]).lower()), WORDS.findall(" ".join(sentences[cut:]).lower())


class Passage:
    """The words of a passage and, made when asked for, its runs of any length up to five."""

    def __init__(self, words: list[int]):
        self.words, self.runs = words, {}

    def share(self, part: list[int], own: set[tuple[int, ...]]) -> float:
        """Share of a part's shingles in the passage; of no part, all."""
        size = min(SHINGLE, len(part))
        if size not in self.runs:
            self.runs[size] = {tuple(self.words[i : i + size]) for i in range(len(self.words) - size + 1)}
        return len(own & self.runs[size]) / len(own) if own else 1.0


class Item:
    """Whole item, question and answer, each with its shingles; `alone` are those that are indexed."""

    def __init__(self, item_id: Any, text: str, vocabulary: Vocabulary):
        self.item_id = item_id
        question, answer = ([vocabulary.setdefault(w, len(vocabulary)) for w in part] for part in question_and_answer(text))
        self.parts = [(words, shingles(words)) for words in (question + answer, question, answer)]
        least = (1, QUESTION_WORDS if answer else len(question) + 1, ANSWER_WORDS if question else len(answer) + 1)
        self.alone = [len(words) >= n for (words, _), n in zip(self.parts, least, strict=True)]

    def overlaps(self, passage: Passage) -> tuple[bool, list[float]]:
        """Whether the passage leaks the item, and the shares of the whole, of the question and of the answer in it."""
        shares = [passage.share(*part) for part in self.parts]
        return any(alone and share >= OVERLAP for alone, share in zip(self.alone, shares, strict=True)), shares


class Statistics(NamedTuple):
    """Of all items with a word: their number, mean and greatest number of words, and in how many each word stands."""

    items: int
    average: float
    longest: int
    held: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for text in texts if (w := sum(question_and_answer(text), []))]
        lengths = [len(w) for w in words] or [1]
        return cls(len(words), sum(lengths) / len(lengths), max(lengths), Counter(w for own in words for w in set(own)))


class BlockMaxIndex:
    """Impacts of each part's terms, and their maxima over blocks of parts as shares of the parts' thresholds."""

    def __init__(self, texts: list[tuple[Any, str | None]], statistics: Statistics | None = None):
        self.vocabulary = Vocabulary()
        known = statistics or Statistics.of([text or "" for _, text in texts])
        items = [Item(item_id, text or "", self.vocabulary) for item_id, text in texts]
        self.items = sorted((item for item in items if item.parts[0][0]), key=lambda item: (len(item.parts[0][0]), str(item.item_id)))
        self.stride = known.longest
        held = np.array([known.held[word] for word in self.vocabulary], np.float64)
        rare = np.log1p((known.items - held + 0.5) / (held + 0.5))
        parts = sorted((len(item.parts[k][0]), i, k) for i, item in enumerate(self.items) for k in range(3) if item.alone[k])
        self.owner = [i for _, i, _ in parts]
        self.terms, self.impacts, self.bounds = [], [], []
        self.whole = dict.fromkeys(range(len(self.items)), 0)
        self.maxima = np.zeros((len(self.vocabulary) + 1, max(1, -(-len(parts) // BLOCK_PARTS))), np.float32)
        for number, (length, i, k) in enumerate(parts):
            words, own = self.items[i].parts[k]
            terms, times = np.unique(words, return_counts=True)
            impact = rare[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / known.average))
            missing = int((1 - OVERLAP) * len(own) + 1e-9)  # a missing shingle takes one word with it at most
            bound = max(impact.sum() - np.sort(impact)[::-1][:missing].sum(), impact.min() / 2)
            self.terms.append(terms)
            self.impacts.append(impact)
            self.bounds.append(bound)
            if k == 0:
                self.whole[i] = number
            np.maximum.at(self.maxima[:, number // BLOCK_PARTS], terms, (impact / bound).astype(np.float32))

    def _score(self, part: int, terms_seen: np.ndarray) -> float:
        return float(self.impacts[part][terms_seen[self.terms[part]]].sum())

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        """Per text, the items that a passage of it holds."""
        found: list[dict[Any, Any]] = [{} for _ in texts]
        number = self.vocabulary.__getitem__
        each = [list(map(number, WORDS.findall(text.lower()))) for text in texts]
        words = np.array([w for own in each for w in own], np.int64)
        if not len(words) or not self.items:
            return [[] for _ in texts]
        ends = np.cumsum([len(own) for own in each])
        begins = ends - np.diff(ends, prepend=0)
        halves = -(-(ends - begins) // self.stride)
        text_of = np.repeat(np.arange(len(texts)), halves)
        first = begins[text_of] + (np.arange(len(text_of)) - np.repeat(np.cumsum(halves) - halves, halves)) * self.stride
        # distinct terms of each passage; it is two strides long, so any run as long as the longest item lies in one
        last = len(self.vocabulary)
        own_half = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
        known = words >= 0
        pairs = own_half[known] * last + words[known]
        earlier = pairs[(own_half[known] > 0) & (text_of[own_half[known]] == text_of[own_half[known] - 1])] - last
        passages, terms = np.divmod(np.unique(np.concatenate([pairs, earlier])), last)
        starts = np.flatnonzero(np.diff(passages, prepend=-1))
        terms_seen = np.zeros(len(self.vocabulary) + 1, bool)
        step = max(1, GATHERED // (self.maxima.shape[1] * 2 * self.stride))
        for begin in range(0, len(starts), step):
            some = starts[begin : begin + step]
            end = starts[begin + step] if begin + step < len(starts) else len(terms)
            bound = np.add.reduceat(self.maxima[terms[some[0] : end]], some - some[0], axis=0)
            passage, at, asked = None, -1, set()
            for row, block in np.argwhere(bound >= 1 - ROUNDING):
                if at != passages[some[row]]:
                    at, asked = passages[some[row]], set()
                    text = int(text_of[at])
                    held = words[first[at] : min(first[at] + 2 * self.stride, ends[text])]
                    terms_seen[:] = False
                    terms_seen[held] = True
                    terms_seen[-1] = False
                    passage = Passage(held.tolist())
                for k in range(block * BLOCK_PARTS, min((block + 1) * BLOCK_PARTS, len(self.owner))):
                    i = self.owner[k]
                    if i in asked or self._score(k, terms_seen) < self.bounds[k] * (1 - ROUNDING):
                        continue
                    asked.add(i)
                    leaked, (overlap, question, answer) = self.items[i].overlaps(passage)
                    if not leaked:
                        continue
                    item_id = self.items[i].item_id
                    leak = (overlap, question, answer, self._score(self.whole[i], terms_seen))
                    found[text][item_id] = max(found[text].get(item_id, leak), leak)
        found = [{i: dict(zip(LEAK.names, (i, *leak), strict=True)) for i, leak in x.items()} for x in found]
        return [sorted(x.values(), key=fullest) for x in found]


def item_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: sum(question_and_answer(text or ""), []))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of `docs` and `leaks`: the items that the whole text holds, the fullest first, with overlaps and BM25 score.

    A leak holds, within one passage, 0.8 of the five-word shingles (fewer words: all of them) of an item, of its question if that has
    8 words or more, or of its answer if that has 13. Null and empty texts, and an empty benchmark, give no leaks; items without an
    id or a word are never found; ids are whole numbers, also as text, and what is none counts as no id. Rows are taken one by one; a
    column already called `leaks` is replaced. The corpus is read once: items go to the tasks in indexes of about SHARD_ITEMS
    items, with the statistics of all items, and each batch of texts asks one after another.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.expr(f"try_cast(`{item_id}` AS long)").alias("item_id"), F.col(item_text).alias("text"))
    items = items.where("item_id IS NOT NULL").distinct()
    items = written(items.withColumn("words", F.pandas_udf(item_words, "array<string>")("text")).where(F.size("words") > 0), "decontaminate-items")
    number = F.size("words")
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.char_length("text")).alias("chars"), F.avg(number).alias("mean"), F.max(number).alias("most")).first()
    shards = 1 + max(size["items"] // SHARD_ITEMS, (size["chars"] or 0) // SHARD_CHARS)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    shard_words = items.select("shard", F.explode(F.array_distinct("words")).alias("word"))
    held = shard_words.groupBy("shard", "word").count()
    held = written(held.withColumn("held", F.sum("count").over(Window.partitionBy("word"))), "decontaminate-words")
    indexes = []
    for shard in range(shards if size["items"] else 0):
        counts = {r["word"]: r["held"] for r in held.where(F.col("shard") == shard).select("word", "held").collect()}
        own = [(x["item_id"], x["text"]) for x in items.where(F.col("shard") == shard).collect()]
        indexes.append(shipped(spark, BlockMaxIndex(own, Statistics(size["items"], size["mean"], size["most"], counts))))
    columns = [c for c in docs.columns if c != "leaks"]
    at = columns.index(text_column)
    rows = docs.select(*columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("leaks", T.ArrayType(LEAK))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((f.name, pa.float64()) for f in LEAK.fields[1:])]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(at).to_pylist()]
            for start, end in chunks(texts, 1_000_000):
                leaks: list[list[dict]] = [[] for _ in range(start, end)]
                for index in indexes:
                    leaks = [[*x, *y] for x, y in zip(leaks, index().leaks(texts[start:end]), strict=True)]
                leaks = [sorted(x, key=fullest) for x in leaks]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, pa.array(leaks, kind)], [*columns, "leaks"])

    return rows.mapInArrow(ask, schema)

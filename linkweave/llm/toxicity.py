"""Toxicity by nearest labelled examples: exact cosine of whole TF-IDF vectors over block-max inverted indexes, distance-weighted votes.

Terms are all words that MIN_TEXTS labelled texts hold, whatever their number and class; document frequencies are counted over all
texts, and weights know no labels. One index holds both classes: rare terms have postings, frequent ones blocks of like examples of a class
with each term's largest weight, so that a search scores only blocks that can still hold one of the nearest examples of their class, and yet
finds exactly these. Texts are searched in batches of like ones, a few blocks in one matrix product. The nearest of both classes vote. A vote
weighs more the nearer the example is, and by the strongest sign of its own class (likelihood ratio of a word's counts in the classes) among
the words it shares with the text. The share of toxic votes is calibrated on other labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from linkweave.llm.common import chunks, held_out, sampled, shipped
from linkweave.session import written

LABELLED_ROWS = 20_000  # labelled texts that terms, examples and calibration are fitted on
MIN_TEXTS = 5
NEIGHBOURS = 15  # of each class
BLOCK = 64
FIRST_BLOCKS = 4  # scored first, for a bound on the others
JOINED = 8  # neighbouring blocks scored in one product
COPIED = 100  # postings of a term that are copied as one piece, others one by one
CELLS = 2  # of the blocks' matrices for each posting: how many of the most frequent terms go to blocks
CLUSTERS = 32  # whose examples stand next to each other in blocks
SEARCHED = 256  # texts searched together
SORTED = 1024  # texts whose words are looked up together, and that are dealt to searches by likeness
CALIBRATION_SHARE = 4  # one of so many labelled texts calibrates, the others are examples
BUILT = 1000  # examples whose weights are made together
SCORED = 20_000  # texts whose scores a task remembers for their copies
POSTING = np.dtype([("place", np.int32), ("weight", np.float32)])  # copied as one long
WORDS = re.compile(r"[^\W\d_]+")
LETTERS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORDS.findall(text.lower()) if text else []


class Vocabulary:
    """Numbers of the known words."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.large_string())

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many known words each text has; one text after another, the numbers of these, rising, and how often each stands in it.

        The words are those of `words_of`; what lies between other ASCII characters needs its pattern only if it is no known word.
        """
        plain = pa.array([(text or "").lower().encode().translate(LETTERS) for text in texts], pa.large_string())
        tokens = pc.ascii_split_whitespace(plain)
        owners, words = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens)
        numbers = self._numbers(words)
        other = np.flatnonzero((numbers < 0) & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        if len(other):  # a lookup prepares all known words, whatever it looks for
            parts = [WORDS.findall(word) for word in words.take(pa.array(other)).to_pylist()]
            owners = np.concatenate([owners, np.repeat(owners[other], [len(x) for x in parts])])
            numbers = np.concatenate([numbers, self._numbers(pa.array([word for x in parts for word in x], pa.large_string()))])
        known = numbers >= 0
        keys, times = np.unique(owners[known] * (len(self.terms) + 1) + numbers[known], return_counts=True)
        owners, terms = np.divmod(keys, len(self.terms) + 1)
        return np.bincount(owners, minlength=len(texts)).astype(np.int32), terms.astype(np.int32), times.astype(np.int32)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, self.terms).fill_null(-1).to_numpy().astype(np.int64)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Those of one text."""
        return self.vectors([text])[1:]


def alike(rows: np.ndarray) -> np.ndarray:
    """An order of the rows that puts like ones together: a few rounds of spherical k-means, each cluster followed by the likest of those left; inside, by length."""
    centres = rows[np.linspace(0, len(rows) - 1, min(CLUSTERS, len(rows))).astype(np.int64)]
    for _ in range(5):
        own = (rows @ centres.T).argmax(1)
        for i in range(len(centres)):
            total = rows[own == i].sum(0)
            centres[i] = total / max(np.linalg.norm(total), 1e-9)
    chain, near = [0], centres @ centres.T
    while len(chain) < len(centres):
        near[:, chain[-1]] = -1
        chain.append(int(near[chain[-1]].argmax()))
    return np.lexsort((np.linalg.norm(rows, axis=1), np.argsort(chain)[own]))


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples, in the order given: `sizes` of their vectors, all `terms` and `times` one after another.

    With `classes`, how many of the examples, one class after another, belong to each: the nearest of each class are found.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, idf: np.ndarray, classes: tuple[int, ...] | None = None):
        self.sizes, self.terms, self.times, self.idf, self.classes = sizes, terms, times, idf, classes or (len(sizes),)
        self.weights: np.ndarray | None = None  # weights, postings and blocks are made where the first search runs

    def __getstate__(self) -> dict[str, Any]:
        """Counts alone go to the tasks, which make the rest again."""
        return {"sizes": self.sizes, "terms": self.terms, "times": self.times, "idf": self.idf, "classes": self.classes, "weights": None}

    def _build(self) -> None:
        size, known = len(self.sizes), len(self.idf)
        self.offsets = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.slots = np.zeros(known, np.int32)
        # the most frequent terms: a dense matrix in blocks
        held = np.bincount(self.terms, minlength=known)
        frequent = np.argsort(-held, kind="stable")[: -(-CELLS * len(self.terms) // max(1, size))]
        self.column = np.full(known, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        dense = np.zeros((size, len(frequent)), np.float32)
        self.weights = np.empty(len(self.terms))
        for start in range(0, size, BUILT):
            sizes = self.sizes[start : start + BUILT]
            part = slice(self.offsets[start], self.offsets[start] + sizes.sum())
            numbers, column = np.repeat(np.arange(len(sizes)), sizes), self.column[self.terms[part]]
            weights = self._plain(self.terms[part], self.times[part])
            weights /= np.maximum(np.sqrt(np.bincount(numbers, weights**2, len(sizes))), 1e-12)[numbers]
            seen = column >= 0
            dense[start + numbers[seen], column[seen]] = weights[seen]
            self.weights[part] = weights
        # every class has blocks of its own
        ends = np.cumsum(self.classes)
        self.edges = np.cumsum([0, *(-(-n // BLOCK) for n in self.classes)])
        self.blocks = np.zeros((self.edges[-1], BLOCK, len(frequent)), np.float32)
        self.order = np.full(self.edges[-1] * BLOCK, -1)
        for start, end, edge in zip(ends - self.classes, ends, self.edges, strict=False):
            if start < end:
                places = slice(edge * BLOCK, edge * BLOCK + end - start)
                self.order[places] = start + alike(dense[start:end])
                self.blocks.reshape(-1, len(frequent))[places] = dense[self.order[places]]
        del dense
        self.maxima = self.blocks.max(1)
        # the others: postings by term
        place = np.empty(size, np.int32)
        taken = np.flatnonzero(self.order >= 0)
        place[self.order[taken]] = taken
        rare = self.column[self.terms] < 0
        terms = self.terms[rare]
        order = np.argsort(terms, kind="stable")
        self.first = np.searchsorted(terms, np.arange(known + 1), sorter=order)
        postings = np.empty(len(terms), POSTING)
        postings["place"] = np.repeat(place, self.sizes)[rare][order]
        postings["weight"] = self.weights.astype(np.float32)[rare][order]
        self.postings = postings.view(np.int64)
        self.lengths = np.diff(self.first)
        self.long = {term: self.postings[self.first[term] : self.first[term + 1]] for term in np.flatnonzero(self.lengths >= COPIED).tolist()}
        # twice what sums of so many products of single precision can be off, as both vectors have length 1
        self.slack = 2 * (len(frequent) + 8) * 2.0**-24 + 1e-8

    def _plain(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights before they are brought to length 1."""
        return (1 + np.log(times)) * self.idf[terms] if len(terms) else np.zeros(0)

    def weighted(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights of a text's unit vector."""
        weights = self._plain(terms, times)
        return weights / max(np.linalg.norm(weights), 1e-12)

    def _shared(self, numbers: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All terms that a text shares with these examples, example by example: which of the text's terms, their weights in the examples, and where each example's begin.

        Each example shares one at least.
        """
        starts, sizes = self.offsets[numbers], self.sizes[numbers]
        own = np.concatenate([self.terms[start:end] for start, end in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)])
        self.slots[terms] = np.arange(1, len(terms) + 1)
        found = self.slots.take(own)
        self.slots[terms] = 0
        at = np.flatnonzero(found != 0)
        before = np.cumsum(sizes) - sizes
        begins = at.searchsorted(before)
        held = np.append(begins[1:], len(at)) - begins
        return found.take(at) - 1, self.weights.take(at + np.repeat(starts - before, held)), begins

    def _rare_terms(self, texts: int, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rare terms and their weights, of each text those with long postings first; and where each text's begin, change and end."""
        gathered = self.lengths[terms] < COPIED
        order = np.argsort(2 * owner + gathered, kind="stable")
        held = np.bincount(owner, minlength=texts)
        ends = np.cumsum(held)
        return terms[order], weights[order].astype(np.float32), ends - held, ends - np.bincount(owner[gathered], minlength=texts), ends

    def _rare(self, terms: np.ndarray, weights: np.ndarray, middle: int) -> np.ndarray:
        """The part of one text's rare terms in the cosine of every place; the first `middle` terms have long postings."""
        lengths = self.lengths[terms]
        short = lengths[middle:]
        at = np.repeat(self.first[terms[middle:]] + short - np.cumsum(short), short)
        at += np.arange(len(at))
        held = np.concatenate([*map(self.long.__getitem__, terms[:middle].tolist()), self.postings.take(at)]).view(POSTING)
        values = np.repeat(weights, lengths)
        values *= held["weight"]
        return np.bincount(held["place"], values, len(self.order))

    def _frequent(self, scores: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> None:
        """Adds the frequent terms' part to all (text, block) pairs that are wanted; neighbouring blocks share a product."""
        for start in range(0, len(self.blocks), JOINED):
            part = self.blocks[start : start + JOINED]
            rows = np.flatnonzero(wanted[:, start : start + JOINED].any(1))
            if len(rows):
                scores[rows, start : start + JOINED] += (asked[rows] @ part.reshape(-1, part.shape[2]).T).reshape(len(rows), -1, BLOCK)

    def nearest(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of one text, as `search` has them."""
        return self.search(np.array([len(terms)]), terms, times, k)[0][:2]

    def search(self, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
        """For each text, what `search_classes` has for the first class: all examples, if they are of one."""
        return [found[0] for found in self.search_classes(sizes, terms, times, k)]

    def search_classes(self, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, k: int, signs: list[np.ndarray] | None = None) -> list[list[tuple[np.ndarray, ...]]]:
        """For each text and class, numbers and cosines of the k nearest examples that share a term, nearest first; ties to the smaller number.

        With `signs` of each class, also what `strongest` finds for each of them.

        Postings give every example the rare terms' part of its cosine. A block's bound is the largest of these and its maxima's
        part. The blocks of a class with the highest bounds give a first k-th cosine; then every block whose bound reaches it is scored, in single
        precision. Whatever may be among the k by the error of that gets its cosine again in double precision.
        """
        texts, nothing = len(sizes), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        if not texts or not len(self.sizes):
            return [[nothing] * len(self.classes)] * texts
        if self.weights is None:
            self._build()
        owner, ends = np.repeat(np.arange(texts), sizes), np.cumsum(sizes)
        weights = self._plain(terms, times)
        weights /= np.sqrt(np.bincount(owner, weights**2, texts))[owner]
        blocks, _, columns = self.blocks.shape
        asked = np.zeros((texts, columns), np.float32)
        column = self.column[terms]
        seen = column >= 0
        asked[owner[seen], column[seen]] = weights[seen]
        rare, rare_weights, *parts = self._rare_terms(texts, owner[~seen], terms[~seen], weights[~seen])
        parts = np.stack(parts, 1).tolist()
        most = np.diff(self.edges).argmax()
        likest = np.argsort((asked @ self.maxima[self.edges[most] : self.edges[most + 1]].T).argmax(1), kind="stable")  # texts near the same blocks are searched together
        found = [[nothing] * len(self.classes)] * texts
        for batch in np.split(likest, range(SEARCHED, texts, SEARCHED)):
            scores = np.zeros((len(batch), blocks, BLOCK), np.float32)
            for row, text in zip(scores.reshape(len(batch), -1), batch, strict=True):
                start, middle, end = parts[text]
                if start < end:
                    row[:] = self._rare(rare[start:end], rare_weights[start:end], middle - start)
            for text, sides in zip(batch.tolist(), self._near(scores, asked[batch], k), strict=True):
                held = slice(ends[text] - sizes[text], ends[text])
                if any(map(len, sides)):
                    found[text] = self._nearest(sides, terms[held], weights[held], k, signs)
        return found

    def _near(self, scores: np.ndarray, asked: np.ndarray, k: int) -> Iterator[list[np.ndarray]]:
        """For each text and class, the places that may be among the k nearest; `scores` have the rare terms' part."""
        texts, blocks, _ = scores.shape
        flat = scores.reshape(texts, -1)
        bound = scores.max(2) + asked @ self.maxima.T
        least = np.zeros((texts, blocks), np.float32)
        for start, end in zip(self.edges, self.edges[1:], strict=False):
            first = np.argsort(-bound[:, start:end], axis=1)[:, :FIRST_BLOCKS] + start
            likely = np.take_along_axis(scores, first[:, :, None], 1)
            for block in np.unique(first):
                rows, places = np.nonzero(first == block)
                likely[rows, places] += asked[rows] @ self.blocks[block].T
            likely = likely.reshape(texts, -1)
            if likely.shape[1] >= k:
                least[:, start:end] = (np.partition(likely, -k, 1)[:, -k] - self.slack)[:, None]
        self._frequent(scores, asked, bound >= least)
        near = (scores >= np.maximum(least, np.finfo(np.float32).tiny)[:, :, None]).reshape(texts, -1)
        edges = (self.edges * BLOCK).tolist()
        for i in range(texts):
            sides = []
            for start, end in zip(edges, edges[1:], strict=False):
                places = start + np.flatnonzero(near[i, start:end])
                if len(places) > k:
                    likely = flat[i].take(places)
                    places = places[likely >= np.partition(likely, -k)[-k] - self.slack]
                sides.append(places)
            yield sides

    def _nearest(self, sides: list[np.ndarray], terms: np.ndarray, weights: np.ndarray, k: int, signs: list[np.ndarray] | None) -> list[tuple[np.ndarray, ...]]:
        """Exact cosines of a text and the examples at these places of each class, and the k nearest of each class."""
        numbers = self.order[np.concatenate(sides)]
        own, products, begins = self._shared(numbers, terms)
        products *= weights.take(own)
        cosines = np.round(np.add.reduceat(products, begins), 9)
        begins = np.append(begins, len(own))
        nearest, start = [], 0
        for i, places in enumerate(sides):
            stop = start + len(places)
            order = np.lexsort((numbers[start:stop], -cosines[start:stop]))[:k]
            strong = cosines[start:stop]
            if signs is not None and len(places):
                first = begins[start]
                strong = np.maximum.reduceat(signs[i][terms].take(own[first : begins[stop]]), begins[start:stop] - first)
            nearest.append((numbers[start:stop][order], cosines[start:stop][order], strong[order]))
            start = stop
        return nearest

    def strongest(self, numbers: np.ndarray, terms: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """For each of these examples, the largest of `signs` among the terms it shares with the text."""
        own, _, begins = self._shared(numbers, terms)
        return np.maximum.reduceat(signs[terms].take(own), begins)


class Voters:
    """The examples of one class, with their ids, copies and the strength of each term as a sign of the class."""

    def __init__(self, examples: pa.Table, idf: np.ndarray, signs: np.ndarray):
        self.ids = examples["doc_id"].combine_chunks()
        self.copies = examples["copies"].to_numpy().astype(np.float64)
        self.terms, self.times = (np.frombuffer(b"".join(examples[c].to_pylist()), np.int32) for c in ("terms", "times"))
        self.sizes, self.idf, self.signs = examples["size"].to_numpy().astype(np.int32), idf, signs
        self.index: BlockMaxIndex | None = None  # of the examples of all classes, kept with the first


def index_of(voters: tuple[Voters, Voters]) -> BlockMaxIndex:
    """One index of both classes, made where the first search runs; it takes over their counts."""
    if voters[0].index is None:
        parts = [np.concatenate([getattr(side, name) for side in voters]) for name in ("sizes", "terms", "times")]
        voters[0].index = BlockMaxIndex(*parts, voters[0].idf, tuple(len(side.sizes) for side in voters))
        for side in voters:
            side.sizes = side.terms = side.times = None
    return voters[0].index


def votes(voters: tuple[Voters, Voters], sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each text the toxic share of the votes (-1 without a neighbour), and the neighbours, nearest first: their places among the ids of both classes, and cosines."""
    copies = np.concatenate([side.copies for side in voters])
    found = []
    for sides in index_of(voters).search_classes(sizes, terms, times, NEIGHBOURS, [side.signs for side in voters]):
        weights = [float((copies[number] * (1 + sign) / (1.05 - cosine)).sum()) for number, cosine, sign in sides]
        number, cosine = (np.concatenate([side[i] for side in sides]) for i in range(2))
        toxic = np.repeat([0, 1], [len(side[0]) for side in sides])
        order = np.lexsort((number, -toxic, -cosine))
        found.append((weights[1] / sum(weights) if len(order) else -1.0, number[order], cosine[order]))
    return found


def vote(voters: tuple[Voters, Voters], terms: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Those of one text."""
    return votes(voters, np.array([len(terms)]), terms, times)[0]


def isotonic(values: np.ndarray, labels: np.ndarray, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A rising step function from votes to shares of toxic texts, smoothed by one toxic and one clean text half each."""
    order = np.argsort(values, kind="stable")
    steps: list[list[float]] = []
    copies = np.ones(len(values)) if copies is None else copies
    for value, label, times in zip(values[order], labels[order], copies[order], strict=True):
        steps.append([float(label * times), float(times), value])
        while len(steps) > 1 and (steps[-2][2] == steps[-1][2] or steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]):
            hits, size, top = steps.pop()
            steps[-1] = [steps[-1][0] + hits, steps[-1][1] + size, top]
    return np.array([s[2] for s in steps]), np.array([(s[0] + 0.5) / (s[1] + 1) for s in steps])


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One row for each text and label, that of the smallest id, with the number of its `copies`; case and white space make no difference."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    signed = sample.withColumn("sign", F.sha2(F.encode(plain, "UTF-8"), 256))
    same = Window.partitionBy("sign", "toxic")
    placed = signed.withColumn("copies", F.count(F.lit(1)).over(same)).withColumn("place", F.row_number().over(same.orderBy("doc_id", "text")))
    return placed.where("place = 1").select(*sample.columns, "copies")


def class_terms(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words that MIN_TEXTS of the (text, toxic) rows hold, and for both classes each word's likelihood ratio as its sign (0 for the other class's); none without both classes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, toxic = Counter(), Counter()
            for text, label in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                found = {"", *words_of(text)}
                held.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([toxic[t] for t in held], pa.int64())], ["term", "n", "toxic"]
            )

    counts = sample.select("text", "toxic").mapInArrow(emit, "term string, n long, toxic long").groupBy("term")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where((F.col("n") >= MIN_TEXTS) | (F.col("term") == ""))
    found = counts.toArrow().sort_by("term")  # words of LABELLED_ROWS texts; the empty one stands for the texts themselves
    n, toxic = (found[c].to_numpy().astype(np.float64) for c in ("n", "toxic"))
    if not len(n) or not 0 < toxic[0] < n[0]:
        return [], np.zeros((2, 0))
    share, n, toxic = toxic[0] / n[0], n[1:], toxic[1:]
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-9) / expected)
    ratio = np.maximum(2 * (part(toxic, n * share) + part(n - toxic, n * (1 - share))), 0.0)
    return found["term"].to_pylist()[1:], np.stack([np.where(toxic < n * share, ratio, 0.0), np.where(toxic > n * share, ratio, 0.0)])


def document_frequencies(docs: DataFrame, terms: list[str], text_column: str) -> tuple[int, np.ndarray]:
    """Number of all texts, and in how many of them each term stands. A task counts all its texts before it sends them."""
    shared = shipped(docs.sparkSession, Vocabulary(terms), keep=True)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        held = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            for start, end in chunks(texts):
                held[:-1] += np.bincount(known.vectors(texts[start:end])[1], minlength=len(terms))
            held[-1] += len(texts)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["term", "n"])

    rows = docs.select(text_column).mapInArrow(emit, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    counts = np.zeros(len(terms) + 1, np.int64)
    counts[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(counts[-1]), counts[:-1]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> dict[str, Any]:
    """Terms, indexes and calibration. Labels come from about LABELLED_ROWS rows outside the held-out fold; frequencies from all texts.

    An id with several labels counts with the highest. Ids may be of any type that Spark can order.
    """
    known = labels.where(~held_out(F.col(id_column)) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    known = sampled(known, id_column, LABELLED_ROWS, "toxicity")
    texts = docs.select(id_column, F.col(text_column).alias("text"))
    sample = texts.join(F.broadcast(known), id_column).select(F.col(id_column).alias("doc_id"), "text", "toxic")  # LABELLED_ROWS bounds it
    sample = written(distinct_texts(sample), "toxicity-sample")
    terms, signs = class_terms(sample)
    if not terms:
        sums = sample.agg(F.count_if(F.col("toxic").isNotNull()).alias("texts"), F.sum("copies").alias("size"), F.sum(F.col("toxic") * F.col("copies")).alias("hits")).first()
        none = ((sums["hits"] or 0) + 0.5) / ((sums["size"] or 0) + 1)
        return {"terms": [], "voters": None, "steps": (np.array([1.0]), np.array([none])), "none": float(none)}
    vocabulary = shipped(docs.sparkSession, Vocabulary(terms), keep=True)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary()
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for start, end in chunks(texts):
                part = batch.slice(start, end - start)
                sizes, *found = known.vectors(texts[start:end])
                held = [pa.array([x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary()) for values in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(sizes), *held], ["doc_id", "toxic", "copies", "calibrates", "size", "terms", "times"])

    plain = F.xxhash64(F.lit("calibrates"), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")))
    chosen = sample.select("doc_id", "text", "toxic", "copies", (F.pmod(plain, F.lit(CALIBRATION_SHARE)) == 0).alias("calibrates"))
    schema = T.StructType([chosen.schema["doc_id"], *T.StructType.fromDDL("toxic int, copies long, calibrates boolean, size int, terms binary, times binary")])
    counted = written(chosen.mapInArrow(vectors, schema), "toxicity-vectors")
    total, held = document_frequencies(docs, terms, text_column)
    idf = np.log((1 + total) / (1 + held)) + 1
    examples = counted.where("size > 0 and not calibrates").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending"), ("times", "ascending")])
    voters = tuple(Voters(examples.filter(pa.array(examples["toxic"].to_numpy() == label)), idf, signs[label]) for label in (0, 1))
    shared = shipped(docs.sparkSession, voters, keep=True)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared()
        for batch in batches:
            for start in range(0, batch.num_rows, SORTED):
                part = batch.slice(start, SORTED)
                terms, times = (part.column(i).to_pylist() for i in (2, 3))
                sizes = np.array([len(x) // 4 for x in terms])
                shares = [x[0] for x in votes(voters, sizes, *(np.frombuffer(b"".join(x), np.int32) for x in (terms, times)))]
                yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64()), *part.columns[:2]], ["vote", "toxic", "copies"])

    checked = counted.where("calibrates").select("toxic", "copies", "terms", "times").mapInArrow(voted, "vote double, toxic int, copies long").toArrow()
    shares, toxic, copies = (checked[c].to_numpy().astype(np.float64) for c in ("vote", "toxic", "copies"))
    near = shares >= 0
    size, hits, bare, bare_hits = counted.agg(
        F.sum("copies"), F.sum(F.col("toxic") * F.col("copies")), *(F.coalesce(F.sum(F.when(F.col("size") == 0, x)), F.lit(0)) for x in (F.col("copies"), F.col("toxic") * F.col("copies")))
    ).first()
    none = (bare_hits + hits / size) / (bare + 1)
    steps = isotonic(shares[near], toxic[near], copies[near]) if near.any() else (np.array([1.0]), np.array([none]))
    return {"terms": terms, "voters": voters, "steps": steps, "none": float(none)}


def score(docs: DataFrame, trained: dict[str, Any], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `score`, `neighbours` (ids) and `cosines` (the evidence) of each whole text.

    Null and empty texts, and texts without a known term, have no neighbours; they get the toxic share of such labelled texts, counted together with one more of the share of all. Rows with equal
    or null ids are each scored. Without labels of both classes there are no terms, and every score is 0.5 or that share. Only the two columns are read.
    """
    model = {**trained, "words": Vocabulary(trained["terms"]), "terms": None}
    shared = shipped(docs.sparkSession, model, keep=True)  # the bound on labelled rows bounds it
    rows = docs.select(id_column, text_column)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        words, voters, (values, shares) = model["words"], model["voters"], model["steps"]
        examples = pa.concat_arrays([side.ids for side in voters]) if voters else pa.array([], own)
        nothing = -1.0, np.zeros(0, np.int64), np.zeros(0)
        known: dict[bytes, tuple] = {}

        def learn(texts: dict[bytes, str]) -> None:
            found = votes(voters, *words.vectors(list(texts.values()))) if voters else [nothing] * len(texts)
            for key, (share, numbers, cosines) in zip(texts, found, strict=True):
                chance = model["none"] if share < 0 else float(shares[min(np.searchsorted(values, share), len(shares) - 1)])
                known[key] = chance, numbers, cosines

        for batch in batches:
            for part in (batch.slice(i, SORTED) for i in range(0, batch.num_rows, SORTED)):
                texts = [text or "" for text in part.column(1).to_pylist()]
                for start, end in chunks(texts):
                    keys = [xxhash.xxh3_128_digest(text) for text in texts[start:end]]
                    if len(known) >= SCORED:
                        known.clear()
                    learn({key: text for key, text in zip(keys, texts[start:end], strict=True) if key not in known})
                    chances, numbers, cosines = zip(*map(known.__getitem__, keys), strict=True)
                    ends = pa.array(np.cumsum([0, *map(len, numbers)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(start, end - start), pa.array(chances, pa.float64()),
                         pa.ListArray.from_arrays(ends, examples.take(pa.array(np.concatenate(numbers)))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cosines)))],
                        [id_column, "score", "neighbours", "cosines"],
                    )

    given = trained["voters"][0].ids.type if trained["voters"] else None
    learned = T.ArrayType(from_arrow_type(given) if given is not None else rows.schema[0].dataType)
    own = given if given is not None else to_arrow_type(rows.schema[0].dataType)
    added = [T.StructField("score", T.DoubleType()), T.StructField("neighbours", learned), T.StructField("cosines", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(predict, T.StructType([rows.schema[0], *added]))

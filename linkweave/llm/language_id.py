"""Language identification by interpolated Kneser-Ney character models, one per language.

Counting, discounting and back-off weights are DataFrame aggregations over every training text. The finished models are
sorted arrays of gram hashes with log probabilities; a text gets the language of its lowest cross-entropy per character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.common import chunks, held_out, shipped
from linkweave.session import written

ORDER = 4
FACTOR = 1_000_003
PRIMES = 2_147_483_647, 2_147_483_629  # a gram's key is its value modulo both, 62 bits that any long holds
SHARPNESS = 0.05, 0.1, 0.2, 0.4, 0.8, 1.6  # tried for the scores
REJECTED = 1000  # one of so many texts of a language may exceed its bound
STEPS = 2**14  # of a nat, to which bounds are rounded up
WORDS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORDS.findall(text.lower()) if text else []


def framed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with three blanks before and one after it, and where each word's predicted characters end."""
    points = np.frombuffer("".join(f"   {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.cumsum([len(w) + ORDER for w in words])


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER code points up to each predicted character, one row each, and the number of the word it belongs to."""
    points, ends = framed(words)
    rows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    lengths = np.diff(ends, prepend=0) - (ORDER - 1)
    first = ends - lengths - (ORDER - 1)
    index = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return rows[index], np.repeat(np.arange(len(words)), lengths)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of grams, given by their code points; the empty gram has key 0."""
    parts = []
    for prime in PRIMES:
        value = np.zeros(len(columns[0]), np.int64)
        for column in columns:
            value = (value * FACTOR + column + 1) % prime
        parts.append(value)
    return parts[0] * 2**31 + parts[1]


def hashed_sql(names: list[str]) -> Column:
    """The same for columns."""
    parts = []
    for prime in PRIMES:
        value = F.lit(0).cast("long")
        for name in names:
            value = (value * FACTOR + F.col(name) + 1) % prime
        parts.append(value)
    return parts[0] * 2**31 + parts[1]


def gram_counts(rows: DataFrame) -> DataFrame:
    """`lang`, the code points `c1..c4` of each gram, and `n`, from (lang, text) rows. Tasks count a batch before they send it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in range(2))
            texts = [text or "" for text in texts]
            for start, end in chunks(texts):
                seen: dict[str, Counter] = {}
                for lang, text in zip(langs[start:end], texts[start:end], strict=True):
                    seen.setdefault(lang, Counter()).update(words_of(text))
                for lang, counted in seen.items():
                    if counted:
                        yield from grams(lang, counted)

    def grams(lang: str, counted: Counter) -> Iterator[pa.RecordBatch]:
        found, word = windows(list(counted))
        times = np.fromiter(counted.values(), np.int64, len(counted))[word]
        order = np.lexsort(found.T)
        found, times = found[order], times[order]
        new = np.concatenate([[True], (found[1:] != found[:-1]).any(1)])
        first = np.flatnonzero(new)
        columns = [pa.array(found[first, i]) for i in range(ORDER)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(first), pa.string()), *columns, pa.array(np.add.reduceat(times, first))], ["lang", *POINTS, "n"]
        )

    schema = "lang string, " + ", ".join(f"{c} long" for c in POINTS) + ", n long"
    return rows.mapInArrow(count, schema).groupBy("lang", *POINTS).agg(F.sum("n").alias("n"))


POINTS = [f"c{i}" for i in range(1, ORDER + 1)]


def models(grams: DataFrame) -> dict[str, SortedModel]:
    """Each language's model: log probabilities of seen grams and log back-off weights of seen contexts.

    The longest grams have their counts; a shorter one counts in how many different characters can stand before it. From each
    count the order's discount is taken, and what that frees goes to the next shorter context. Each order is a table that the next
    one reads; the driver sees four numbers a language and order, and at the end the models themselves.
    """
    counted = {ORDER: grams}
    for size in range(ORDER - 1, 0, -1):
        names = POINTS[ORDER - size :]
        counted[size] = written(counted[size + 1].groupBy("lang", *names).agg(F.count(F.lit(1)).alias("n")), f"language-counts-{size}")
    sizes = [rows.select("lang", F.lit(size).alias("size"), "n") for size, rows in counted.items()]
    sizes = reduce(DataFrame.unionByName, sizes).groupBy("lang", "size")
    sizes = sizes.agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count(F.lit(1)).alias("kinds")).collect()
    letters = {row["lang"]: row["kinds"] + 1 for row in sizes if row["size"] == 1}  # and one for whatever was never seen
    if not letters:
        return {}
    parts: dict[str, dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]] = {lang: {} for lang in letters}

    def keep(rows: DataFrame, size: int, kind: str, names: list[str]) -> None:
        found = rows.select("lang", hashed_sql(names).alias("hash"), F.log(kind).cast("float").alias("value")).toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
        hashes, values = found["hash"].to_numpy(), found["value"].to_numpy()
        for run in pc.value_counts(found["lang"].combine_chunks()).to_pylist():  # in order of appearance
            n = run["counts"]
            parts[run["values"]][size, kind] = hashes[:n].copy(), values[:n].copy()
            hashes, values = hashes[n:], values[n:]

    by_lang = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]
    shorter = None
    for size in range(1, ORDER + 1):
        names = POINTS[ORDER - size :]
        context = names[:-1]
        discounts = {r["lang"]: min(r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] else 0.5, 0.9) for r in sizes if r["size"] == size}
        own = Window.partitionBy("lang", *context)  # as many rows as letters can follow
        joined = counted[size].withColumn("d", by_lang(discounts)).withColumn("total", F.sum("n").over(own))
        joined = joined.withColumn("rest", F.col("d") * F.count(F.lit(1)).over(own) / F.col("total"))
        if size == 1:
            joined = joined.withColumn("lower", 1 / by_lang(letters))
        else:
            joined = joined.join(shorter.select("lang", *names[1:], F.col("p").alias("lower")), ["lang", *names[1:]])
        chance = (F.col("n") - F.col("d")) / F.col("total") + F.col("rest") * F.col("lower")
        shorter = written(joined.select("lang", *names, chance.alias("p"), "rest"), f"language-order-{size}")
        keep(shorter, size, "p", names)
        keep(shorter.select("lang", *context, "rest").distinct(), size, "rest", context)
    return {lang: SortedModel(-np.log(letters[lang]), arrays) for lang, arrays in parts.items()}


class SortedModel:
    """One language: `floor`, the log probability of an unseen letter, and for each length and kind sorted hashes and their values."""

    def __init__(self, floor: float, arrays: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]):
        self.floor, self.arrays = float(floor), arrays

    def _find(self, size: int, kind: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.arrays[size, kind]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, values[at]

    def log_probabilities(self, grams: dict[int, np.ndarray], contexts: dict[int, np.ndarray]) -> np.ndarray:
        """From the longest gram down: the stored value, or the context's back-off weight and the next shorter gram."""
        result = np.zeros(len(grams[1]), np.float64)
        open_rows = np.arange(len(result))
        for size in range(ORDER, 0, -1):
            seen, value = self._find(size, "p", grams[size][open_rows])
            result[open_rows[seen]] += value[seen]
            open_rows = open_rows[~seen]
            if not len(open_rows):
                return result
            known, rest = self._find(size, "rest", contexts[size][open_rows])
            result[open_rows[known]] += rest[known]
        result[open_rows] += self.floor
        return result


class Identifier:
    """All languages' models; scores texts in batches, each distinct word of a batch once."""

    def __init__(self, model: dict[str, SortedModel]):
        self.langs = sorted(model)
        self.models = [model[lang] for lang in self.langs]

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each model, and its predicted characters."""
        found, word = windows(words)
        columns = [np.ascontiguousarray(found[:, i]).astype(np.int64) for i in range(ORDER)]
        letters, small = np.unique(found, return_inverse=True)  # equal grams are looked up once
        small = small.reshape(found.shape).astype(np.int64)
        keys = ((small[:, 0] * len(letters) + small[:, 1]) * len(letters) + small[:, 2]) * len(letters) + small[:, 3]
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        columns = [column[first] for column in columns]
        grams = {size: hashed(columns[ORDER - size :]) for size in range(1, ORDER + 1)}
        contexts = {size: hashed(columns[ORDER - size : ORDER - 1]) if size > 1 else np.zeros(len(first), np.int64) for size in range(1, ORDER + 1)}
        sums = [np.bincount(word, model.log_probabilities(grams, contexts)[inverse], len(words)) for model in self.models]
        return np.stack(sums, 1), np.bincount(word, minlength=len(words))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each model, and its characters (0: no letter)."""
        number: dict[str, int] = {}
        ids: list[int] = []
        ends = []
        for text in texts:
            ids += [number.setdefault(word, len(number)) for word in words_of(text)]
            ends.append(len(ids))
        entropy, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if not ids:
            return entropy, size
        scores, characters = self.word_scores(list(number))
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        word = np.array(ids)
        size = np.bincount(text_of, characters[word], len(texts))
        for i in range(len(self.langs)):
            entropy[:, i] = -np.bincount(text_of, scores[word, i], len(texts)) / np.maximum(size, 1)
        return entropy, size


def learns(id_column: str, lang_column: str) -> Column:
    """True for rows with a language outside the held-out fold."""
    return ~held_out(F.col(id_column)) & F.col(lang_column).isNotNull() & (F.col(lang_column) != UNKNOWN)


def learned(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> dict[str, SortedModel]:
    """Models of all learning texts."""
    rows = docs.where(learns(id_column, lang_column)).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    return models(written(gram_counts(rows), "language-grams"))


def measured(rows: DataFrame, model: dict[str, SortedModel]) -> DataFrame:
    """All columns but the last, the text; `_entropy`, nats per character under each language's model, by name; `_size`, characters (0: no letter or no model)."""
    shared = shipped(rows.sparkSession, Identifier(model) if model else None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = shared()
        for batch in batches:
            texts = [text or "" for text in batch.columns[-1].to_pylist()]
            for start, end in chunks(texts):
                entropy, size = identifier.cross_entropies(texts[start:end]) if identifier else (np.zeros((end - start, 0)), np.zeros(end - start))
                ends = pa.array(np.arange(end - start + 1) * entropy.shape[1], pa.int32())
                held = [column.slice(start, end - start) for column in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(ends, pa.array(entropy.ravel())), pa.array(size, pa.float64())], names)

    added = [T.StructField("_entropy", T.ArrayType(T.DoubleType())), T.StructField("_size", T.DoubleType())]
    names = [*rows.columns[:-1], "_entropy", "_size"]
    return rows.mapInArrow(measure, T.StructType([*rows.schema[:-1], *added]))


def entropies(batch: pa.RecordBatch, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of `measured`, the last ones of a batch: a row a text and a column a language; sizes."""
    entropy, size = batch.columns[-2:]
    return pc.list_flatten(entropy).to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(langs)), size.to_numpy()


def calibrated(seen: DataFrame, model: dict[str, SortedModel]) -> dict[str, Any]:
    """The model with sharpness and bounds of all rows (language, or null where a row teaches nothing, and `measured`'s columns).

    Tasks send sums for each language and step of cross-entropy, as many as there are steps, whatever the number of texts. The
    sharpness is the one tried whose scores have the least mean log loss; a bound is the first step that no more than one of
    REJECTED texts exceeds.
    """
    if not model:
        return {"model": {}, "sharpness": 1.0, "bounds": {}}
    langs = sorted(model)
    losses = [f"loss{i}" for i in range(len(SHARPNESS))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            own = np.array([number.get(lang, -1) for lang in batch.column(0).to_pylist()], np.int64)
            entropy, size = entropies(batch, langs)
            use = (size > 0) & (own >= 0)
            own, entropy, size, row = own[use], entropy[use], size[use], np.arange(use.sum())
            steps = np.ceil(entropy[row, own] * STEPS).astype(np.int64)
            keys, place = np.unique(steps * len(langs) + own, return_inverse=True)
            lost = [-np.log(np.maximum(posterior(entropy, size, t)[row, own], 1e-9)) for t in SHARPNESS]
            lost = [pa.array(np.bincount(place, x, len(keys)), pa.float64()) for x in lost]
            yield pa.RecordBatch.from_arrays([pa.array(keys % len(langs)), pa.array(keys // len(langs)), pa.array(np.bincount(place, minlength=len(keys))), *lost], ["own", "step", "n", *losses])

    schema = "own long, step long, n long, " + ", ".join(f"{x} double" for x in losses)
    found = seen.mapInArrow(sums, schema).groupBy("own", "step").agg(*(F.sum(x).alias(x) for x in ["n", *losses])).toArrow()
    found = found.sort_by([("own", "ascending"), ("step", "ascending")])
    own, step, n = (found[x].to_numpy() for x in ("own", "step", "n"))
    bounds = {}
    for i in np.unique(own):
        held = n[own == i]
        beyond = held.sum() - np.cumsum(held)
        bounds[langs[i]] = float(step[own == i][np.argmax(beyond * REJECTED <= held.sum())] / STEPS)
    total = [float(found[x].to_numpy().sum()) for x in losses]
    return {"model": model, "sharpness": SHARPNESS[int(np.argmin(total))] if len(own) and len(langs) > 1 else 1.0, "bounds": bounds}


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict[str, Any]:
    """Models and calibration from all rows with a language outside the held-out fold.

    Counts, the sharpness of the scores and each language's rejection bound (the cross-entropy that one in a thousand of its own texts
    exceeds) cover all of those texts.
    """
    model = learned(docs, id_column, text_column, lang_column)
    return calibrated(measured(docs.where(learns(id_column, lang_column)).select(lang_column, text_column), model), model)


def posterior(entropy: np.ndarray, size: np.ndarray, sharpness: float) -> np.ndarray:
    """Share of each language: likelihoods flattened by `sharpness`, which grows with the root of the text's length."""
    logits = -entropy * sharpness * np.sqrt(size)[:, None] * 10
    weights = np.exp(logits - logits.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def identify(docs: DataFrame, trained: dict[str, Any], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `lang_pred`, `score` (share of the chosen language), `cross_entropy` and `rejected` of each whole text.

    Null texts, texts without a letter and models without a language give `und`, score 0 and rejected. Ties go to the first
    language by name. `rejected` marks texts that fit their best language worse than its calibrated bound. Only the two named columns are read.
    """
    return decided(measured(docs.select(id_column, text_column), trained["model"]), trained)


def train_and_identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """`identify` by what `train` learns from the same rows; each text is measured once for both."""
    model = learned(docs, id_column, text_column, lang_column)
    own = F.when(learns(id_column, lang_column), F.col(lang_column)).alias("_own")
    seen = written(measured(docs.select(F.col(id_column).alias("_id"), own, F.col(text_column).alias("_text")), model), "language-entropies")
    return decided(seen.select(F.col("_id").alias(id_column), "_entropy", "_size"), calibrated(seen.select("_own", "_entropy", "_size"), model))


def decided(seen: DataFrame, trained: dict[str, Any]) -> DataFrame:
    """`identify`'s columns from the id and `measured`'s columns."""
    langs, sharpness, bounds = sorted(trained["model"]), trained["sharpness"], trained["bounds"]
    name_of_id = seen.columns[0]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, size = entropies(batch, langs)
            if langs:
                best = entropy.argmin(1)
                least = entropy[np.arange(len(best)), best]
                names = [langs[i] if n else UNKNOWN for i, n in zip(best, size, strict=True)]
                score = np.where(size > 0, posterior(entropy, size, sharpness)[np.arange(len(best)), best], 0.0)
            else:
                names, score, least = [UNKNOWN] * len(size), size, size
            rejected = [not n or bool(e > bounds.get(name, np.inf)) for name, e, n in zip(names, least, size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                 pa.array(np.where(size > 0, least, np.nan), pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())],
                [name_of_id, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType())]
    return seen.mapInArrow(predict, T.StructType([seen.schema[0], *added, T.StructField("rejected", T.BooleanType())]))

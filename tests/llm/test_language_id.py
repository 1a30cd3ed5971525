import random
import zlib
from collections import Counter

import numpy as np
import pytest

from linkweave.llm import language_id
from linkweave.llm.language_id import Identifier, identify, train, windows, words_of
from tests.llm.samples import DOCUMENTS, edge_documents

SYLLABLES = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["éo", "ça", "ux", "ri"]}


@pytest.fixture(scope="module")
def docs(spark):
    chosen = random.Random(4)
    rows = []
    for i in range(300):
        lang = chosen.choice(sorted(SYLLABLES))
        words = ["".join(chosen.choices(SYLLABLES[lang], k=chosen.randrange(1, 5))) for _ in range(chosen.randrange(3, 40))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if i % 17 else None, "s", 0))
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def trained(docs):
    return train(docs)


def test_held_out_accuracy(docs, trained):
    given = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in identify(docs, trained).collect()}
    held = [i for i in given if zlib.crc32(str(i).encode()) % 5 == 0 and given[i]]
    assert sum(found[i]["lang_pred"] == given[i] for i in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_probabilities_of_a_context_sum_to_one(spark):
    counts = {}
    for word in ["abba", "abab", "baba", "cab", "abba"]:
        found, _ = windows([word])
        for gram in map(tuple, found.tolist()):
            counts[gram] = counts.get(gram, 0) + 1
    grams = spark.createDataFrame([("x", *g, n) for g, n in counts.items()], "lang string, c1 long, c2 long, c3 long, c4 long, n long")
    identifier = Identifier(language_id.models(grams))
    letters = "abc"  # and the blank at a word's end, and one share for anything unseen

    def chance(context, letter):
        columns = [np.array([ord(c)]) for c in (context + letter)[-4:]]
        grams = {n: language_id.hashed(columns[4 - n :]) for n in range(1, 5)}
        contexts = {n: language_id.hashed(columns[4 - n : 3]) if n > 1 else np.zeros(1, int) for n in range(1, 5)}
        return float(np.exp(identifier.models[0].log_probabilities(grams, contexts))[0])

    for context in ("   ", "  a", " ab", "abb", "zzz"):
        total = sum(chance(context, c) for c in letters + " ") + chance(context, "z")
        assert abs(total - 1) < 1e-3


class LiteralModel:
    """Interpolated Kneser-Ney by its definition, on strings and counts in dictionaries."""

    def __init__(self, words):
        self.counts = {4: Counter(f"   {w} "[i : i + 4] for w in words for i in range(len(w) + 1))}
        for size in (3, 2, 1):
            self.counts[size] = Counter(gram[1:] for gram in self.counts[size + 1])  # different letters before it
        self.discounts = {}
        for size, counted in self.counts.items():
            once, twice = (sum(n == times for n in counted.values()) for times in (1, 2))
            self.discounts[size] = min(0.9, once / (once + 2 * twice) if once else 0.5)

    def chance(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        counted, d = self.counts[len(gram)], self.discounts[len(gram)]
        follow = [n for other, n in counted.items() if other[:-1] == gram[:-1]]
        if not follow:
            return self.chance(gram[1:])
        return max(counted[gram] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * self.chance(gram[1:])

    def word(self, word):
        return sum(np.log(self.chance(f"   {word} "[i : i + 4])) for i in range(len(word) + 1))


def test_equals_literal_kneser_ney(docs, trained):
    texts = docs.where("lang is not null").collect()
    learned = {lang: [] for lang in SYLLABLES}
    for row in texts:
        if zlib.crc32(str(row["doc_id"]).encode()) % 5:
            learned[row["lang"]] += words_of(row["text"])
    identifier = Identifier(trained["model"])
    asked = [w for row in texts[:6] for w in words_of(row["text"])[:8]] + ["q", "kaschçx", "日本", "\U00020000a", "k" * 30]
    scores, _ = identifier.word_scores(asked)
    for at, lang in enumerate(identifier.langs):
        literal = LiteralModel(learned[lang])
        assert scores[:, at] == pytest.approx([literal.word(w) for w in asked], rel=1e-4)


def test_rejects_what_fits_no_language(spark, docs, trained):
    strange = spark.createDataFrame([(1, "zzxq wwzx qqzz " * 9, None, "s", 0), (2, "日本語の文", None, "s", 0)], DOCUMENTS)
    assert all(r["rejected"] for r in identify(strange, trained).collect())
    assert sum(r["rejected"] for r in identify(docs, trained).collect()) <= 0.05 * docs.count()


def test_keys_grow_with_the_grams():
    """More grams than any table of two million slots keeps apart: all keys differ, and the columns' keys are the same."""
    points = np.stack(np.meshgrid(np.arange(0x4E00, 0x4E00 + 1700), np.arange(0x4E00, 0x4E00 + 1700)), -1).reshape(-1, 2)
    keys = language_id.hashed([points[:, 0], points[:, 1]])
    assert len(np.unique(keys)) == len(points) > 2_800_000 and keys.min() > 0


def test_keys_in_columns(spark):
    rows = [(0x10FFFF, 32, 97, 0x10FFFF), (32, 32, 32, 0x20000), (1, 2, 3, 4)]
    found = spark.createDataFrame(rows, "c1 long, c2 long, c3 long, c4 long").select(language_id.hashed_sql(language_id.POINTS).alias("key"), language_id.hashed_sql([]).alias("none")).collect()
    assert [r["key"] for r in found] == language_id.hashed([np.array(c) for c in zip(*rows, strict=True)]).tolist() and {r["none"] for r in found} == {0}


def test_words_and_windows():
    assert words_of("It's 3 ÉTÉS, ok_") == ["it", "s", "étés", "ok"] and words_of(None) == words_of("123 !") == []
    found, word = windows(["ab", "c"])
    assert ["".join(map(chr, g)) for g in found] == ["   a", "  ab", " ab ", "   c", "  c "] and word.tolist() == [0, 0, 0, 1, 1]


def test_edge_rows(spark, trained):
    docs = edge_documents(spark).withColumnRenamed("n_chars", "score")
    rows = identify(docs, trained).collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in (3, 4, 5, 7))
    assert all(r["lang_pred"] in SYLLABLES for r in rows if r["doc_id"] in (1, 2, 6, 8, None))
    nothing = train(docs.limit(0))
    assert {r["lang_pred"] for r in identify(docs, nothing).collect()} == {"und"} and identify(docs.limit(0), trained).count() == 0
    train(docs)  # nulls, empty texts and one text a language are no obstacle


def test_calibration_covers_every_learning_text(spark, docs, monkeypatch):
    """Sharpness and bounds follow from all learning texts, those far from the others too, however few rows a sample would hold."""
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 5, raising=False)
    rows = docs.collect() + [(900 + i, "qx zw " * (i + 2) + "ka", "aa", "s", 0) for i in range(12)] + [(950, "ka to ri", "und", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    trained = train(docs)
    identifier, langs = Identifier(trained["model"]), sorted(SYLLABLES)
    learning = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[2] in SYLLABLES]
    entropy, size = identifier.cross_entropies([r[1] for r in learning])
    own = np.array([langs.index(r[2]) for r in learning])
    for i, lang in enumerate(langs):  # fewer than a thousand texts each: none may exceed the bound, the largest just meets it
        assert 0 <= trained["bounds"][lang] - entropy[own == i, i].max() <= 1 / language_id.STEPS
    losses = [-np.log(np.maximum(language_id.posterior(entropy, size, t)[np.arange(len(own)), own], 1e-9)).mean() for t in language_id.SHARPNESS]
    assert trained["sharpness"] == language_id.SHARPNESS[int(np.argmin(losses))]


def test_one_pass_gives_the_same(spark, docs):
    for given in (docs, edge_documents(spark).withColumnRenamed("n_chars", "score"), docs.limit(0)):
        both = [sorted(map(repr, found.collect())) for found in (identify(given, train(given)), language_id.train_and_identify(given))]
        assert both[0] == both[1] and len(both[0]) == given.count()


def test_bound_is_exceeded_by_one_in_a_thousand(spark, trained):
    langs = sorted(trained["model"])
    rows = [(langs[0], [e / 1000, 9.0, 9.0], 5.0) for e in range(3000)] + [(langs[1], [9.0, 1.0, 9.0], 0.0), (None, [9.0, 1.0, 9.0], 5.0)]
    seen = spark.createDataFrame(rows, "own string, _entropy array<double>, _size double")
    bounds = language_id.calibrated(seen, trained["model"])["bounds"]
    assert set(bounds) == {langs[0]} and sum(e / 1000 > bounds[langs[0]] for e in range(3000)) == 3

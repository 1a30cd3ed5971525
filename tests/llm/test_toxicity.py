import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkweave.llm import toxicity
from linkweave.llm.toxicity import BlockMaxIndex, isotonic, score, train
from tests.llm.samples import DOCUMENTS, edge_documents


@pytest.fixture(scope="module")
def tables(spark):
    chosen = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"plain{chosen.randrange(300)}"[: chosen.randrange(5, 9)] for _ in range(chosen.randrange(5, 60))]
        toxic = chosen.random() < 0.2
        if toxic:
            words += chosen.choices(["nastyword", "dreadful", "vileness"], k=chosen.randrange(1, 4))
        chosen.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(tables):
    return train(*tables)


def test_held_out_accuracy(tables, trained):
    docs, labels = tables
    given = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    found = {r["doc_id"]: r for r in score(docs, trained).collect()}
    assert len(found) == 600 and all(0 <= r["score"] <= 1 for r in found.values())
    assert sum((found[i]["score"] >= 0.5) == bool(t) for i, t in given.items()) >= 0.95 * len(given) > 0
    assert not any(i in given for r in found.values() for i in r["neighbours"])


def made_index(counts, idf):
    sizes = np.array([len(c) for c in counts], np.int32)
    terms = np.array([t for c in counts for t in sorted(c)], np.int32)
    return BlockMaxIndex(sizes, terms, np.array([c[t] for c in counts for t in sorted(c)], np.int32), idf)


def test_nearest_are_exact():
    rng = np.random.default_rng(3)
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(30, rng.integers(1, 6), replace=False)} for _ in range(700)]
    index = made_index(counts, rng.uniform(1, 5, 30))
    signs = rng.uniform(0, 9, 30)
    given = [(np.array(sorted(c)), np.array([c[t] for t in sorted(c)])) for c in counts]
    dense = np.zeros((700, 30))
    for i, (terms, times) in enumerate(given):
        dense[i, terms] = index.weighted(terms, times)
    for i in range(0, 700, 7):
        cosines = np.round(dense @ dense[i], 9)
        want = [n for n in np.lexsort((np.arange(700), -cosines)) if cosines[n] > 0][:15]
        numbers, found = index.nearest(*given[i], 15)
        assert np.allclose(found, cosines[want], atol=2e-9)
        clear = cosines[want] > cosines[want][-1] + 1e-8
        assert numbers[clear].tolist() == np.array(want)[clear].tolist()
        assert index.strongest(numbers, given[i][0], signs).tolist() == [max(signs[t] for t in counts[n].keys() & counts[i].keys()) for n in numbers]


def test_calibration_rises():
    values, shares = isotonic(np.array([0.1, 0.1, 0.5, 0.4, 0.9, 0.9]), np.array([0, 0, 1, 0, 1, 1]))
    assert (np.diff(values) > 0).all() and (np.diff(shares) >= 0).all() and 0 < shares[0] < 0.5 < shares[-1] < 1


def test_edge_rows(spark, tables, trained):
    docs = edge_documents(spark).withColumnRenamed("n_chars", "score")
    rows = score(docs, trained).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] < 0.5 and r["neighbours"] == [] for r in rows)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 1, 1), (6, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        assert score(docs, train(docs, given)).count() == docs.count()
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_vectors_of_words():
    terms, times = toxicity.Vocabulary(["bad", "good"]).vector("good bad Bad 3 other good GOOD")
    assert terms.tolist() == [0, 1] and times.tolist() == [2, 3]
    assert [x.tolist() for x in toxicity.Vocabulary(["bad"]).vector(None)] == [[], []]


def test_weights_know_no_labels(spark, tables, trained):
    """The cosines follow from texts alone: a literal TF-IDF over the whole vocabulary gives each neighbour's."""
    docs, _ = tables
    texts = {r["doc_id"]: toxicity.words_of(r["text"]) for r in docs.collect()}
    idf = {t: np.log(601 / (1 + sum(t in words for words in map(set, texts.values())))) + 1 for t in trained["terms"]}

    def unit(words):
        weights = {t: (1 + np.log(words.count(t))) * idf[t] for t in set(words) if t in idf}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    units = {i: unit(words) for i, words in texts.items()}
    for row in score(docs.where("doc_id < 40"), trained).collect():
        own = units[row["doc_id"]]
        assert row["cosines"] == sorted(row["cosines"], reverse=True) and len(row["cosines"]) <= 30
        for i, cosine in zip(row["neighbours"], row["cosines"], strict=True):
            assert cosine == pytest.approx(sum(w * units[i].get(t, 0) for t, w in own.items()), abs=1e-8)


def test_highest_label_and_text_ids(spark, tables):
    docs, labels = tables
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    twice = labels.unionByName(labels.withColumn("toxic", toxicity.F.lit(0)))
    model = train(named, twice.withColumn("doc_id", twice.doc_id.cast("string")))
    found = {r["doc_id"]: r for r in score(named, model).collect()}
    given = {str(r["doc_id"]): r["toxic"] for r in labels.collect()}
    assert sum((found[i]["score"] >= 0.5) == bool(t) for i, t in given.items()) >= 0.95 * len(given)
    assert all(isinstance(i, str) for r in found.values() for i in r["neighbours"])


def test_every_frequent_word_is_a_term(spark):
    """More signs of the class than any fixed number of terms holds; each stands in ten toxic texts only, beside plain words."""
    chosen = random.Random(5)
    letters = "abcdefghijklmnop"
    signs = [f"vile{a}{b}{c}" for a in letters for b in letters for c in "xy"][:480]
    plain = lambda n: [chosen.choice(["plain", "usual", "common", "normal"]) + chosen.choice(letters) for _ in range(n)]
    texts = [" ".join(plain(12) + [signs[(i + k * 37) % 480] for k in range(10)]) for i in range(480)] + [" ".join(plain(18)) for _ in range(960)]
    docs = spark.createDataFrame([(i, text, "en", "s", 0) for i, text in enumerate(texts)], DOCUMENTS)
    labels = spark.createDataFrame([(i, 1, int(i < 480)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    held = {t for t in model["terms"] if t.startswith("vile")}
    assert len(held) > 400 and any(t.startswith("plain") for t in model["terms"])
    found = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert sum((found[i] >= 0.5) == (i < 480) for i in found if zlib.crc32(str(i).encode()) % 5 == 0) >= 270


def test_only_equal_texts_are_one(spark):
    """Texts that share a passage stay apart, so do equal texts of two labels; copies are counted."""
    passage = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, f"{passage} own{i} tail{i}", i % 2) for i in range(40)] + [(50, "An equal\n text", 1), (51, "an  EQUAL text", 1), (52, "an equal text", 0)]
    rows += [(53, None, 0), (54, " ", 0)]
    found = toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()
    assert {(r["doc_id"], r["copies"]) for r in found} == {*((i, 1) for i in range(40)), (50, 2), (52, 1), (53, 2)}
    examples = pa.table({"doc_id": [1], "copies": [3], "size": pa.array([1], pa.int32()), "terms": [np.int32([0]).tobytes()], "times": [np.int32([1]).tobytes()]})
    one = examples.set_column(1, "copies", pa.array([1]))
    sides = toxicity.Voters(one, np.ones(1), np.zeros(1)), toxicity.Voters(examples, np.ones(1), np.zeros(1))
    assert toxicity.vote(sides, np.array([0]), np.array([1]))[0] == pytest.approx(0.75)


def test_batches_of_texts_are_searched_together():
    """Each text finds what it finds alone and by brute force, in less time than a pass over its terms' postings takes, text by text."""
    rng = np.random.default_rng(8)
    held = lambda: {int(t): int(rng.integers(1, 4)) for t in np.minimum(rng.zipf(1.3, 400), 20_000) + 5_000 * rng.integers(0, 2) - 1}
    counts = [held() for _ in range(6000)]
    index = made_index(counts, rng.uniform(1, 5, 25_000))
    asked = counts[:40] + [{}] + [held() for _ in range(215)]
    sizes = np.array([len(c) for c in asked])
    terms, times = (np.array(x, np.int32) for x in zip(*((t, c[t]) for c in asked for t in sorted(c)), strict=True))
    texts = list(zip(np.split(terms, np.cumsum(sizes)[:-1]), np.split(times, np.cumsum(sizes)[:-1]), strict=True))
    index.nearest(*texts[0], 15)
    began = time.perf_counter()
    found = index.search(sizes, terms, times, 15)
    took = time.perf_counter() - began
    postings = {t: [] for t in range(25_000)}
    for n, c in enumerate(counts):
        weights = index.weighted(np.array(sorted(c)), np.array([c[t] for t in sorted(c)]))
        for t, w in zip(sorted(c), weights, strict=True):
            postings[t].append((n, w))
    postings = {t: tuple(np.array(x) for x in zip(*p, strict=True)) for t, p in postings.items() if p}
    began = time.perf_counter()
    brute = []
    for own_terms, own_times in texts:
        parts = [(*postings[t], w) for t, w in zip(own_terms.tolist(), index.weighted(own_terms, own_times), strict=True) if t in postings]
        at, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([p[0] for p in parts], [p[1] * p[2] for p in parts]))
        brute.append(np.round(np.bincount(at, values, len(counts)), 9))
    literal = time.perf_counter() - began
    for text, (numbers, cosines, _), all_cosines in zip(texts, found, brute, strict=True):
        alone = index.nearest(*text, 15)
        assert alone[0].tolist() == numbers.tolist() and alone[1].tolist() == cosines.tolist()
        assert np.allclose(cosines, np.sort(all_cosines[all_cosines > 0])[::-1][:15], atol=2e-9)
        assert np.allclose(all_cosines[numbers], cosines, atol=2e-9)
    assert not len(found[40][0]) and found[0][0][0] == 0 and took < literal


def test_vectors_hold_the_words():
    texts = ["Bad, bad_good3GOOD", "“straße” Straßé—bad good½x", "ÉTÉ’s été bad", None, "", "İx ς Σ", "\U00010400 naïve bad日本good"]
    terms = sorted({w for text in texts for w in toxicity.words_of(text)} - {"x"})
    sizes, found, times = toxicity.Vocabulary(terms).vectors(texts)
    ends = np.cumsum(sizes)
    for text, end, size in zip(texts, ends, sizes, strict=True):
        own = [w for w in toxicity.words_of(text) if w in terms]
        assert [(terms[t], n) for t, n in zip(found[end - size : end], times[end - size : end], strict=True)] == sorted((w, own.count(w)) for w in set(own))


def test_plain_texts_need_one_lookup(monkeypatch):
    """A lookup prepares all known words; without words in other letters there is nothing to look up again."""
    asked = []
    lookup = toxicity.Vocabulary._numbers
    monkeypatch.setattr(toxicity.Vocabulary, "_numbers", lambda self, words: asked.append(len(words)) or lookup(self, words))
    sizes, terms, times = toxicity.Vocabulary(["bad", "good"]).vectors(["good bad other", "Bad bad", None])
    assert len(asked) == 1 and sizes.tolist() == [2, 1, 0] and terms.tolist() == [0, 1, 0] and times.tolist() == [1, 1, 2]
    assert toxicity.Vocabulary(["bad", "été"]).vectors(["bad été’s"])[1].tolist() == [0, 1] and len(asked) == 3


def test_classes_share_an_index(monkeypatch):
    """Both classes are found in one pass, as in an index of each and by brute force; of two languages in turn, a batch holds one and asks for its blocks alone."""
    rng = np.random.default_rng(4)
    half, idf, signs = 2_000, rng.uniform(1, 5, 4_000), rng.uniform(0, 9, (2, 4_000))
    held = lambda side: {int(t) + half * side: int(rng.integers(1, 4)) for t in np.minimum(rng.zipf(1.4, 80), half) - 1}
    counts = [held(i % 2) for i in range(1800)]
    ends = (1500, 1800)
    arrays = lambda counts: (np.array(x, np.int32) for x in zip(*((t, c[t]) for c in counts for t in sorted(c)), strict=True))
    both = BlockMaxIndex(np.array([len(c) for c in counts], np.int32), *arrays(counts), idf, (1500, 300))
    alone = made_index(counts[:1500], idf), made_index(counts[1500:], idf)
    texts = [held(i % 2) for i in range(2 * toxicity.SEARCHED)] + [{}]
    share, frequent = [], BlockMaxIndex._frequent
    wide = lambda wanted: wanted[~wanted.all(1)].any(0).mean()  # noqa: E731  a text without a neighbour asks for all
    monkeypatch.setattr(BlockMaxIndex, "_frequent", lambda self, scores, asked, wanted: share.append(wide(wanted)) or frequent(self, scores, asked, wanted))
    found = both.search_classes(np.array([len(c) for c in texts]), *arrays(texts), 15, list(signs))
    assert len(share) == 3 and min(share[:2]) < 0.8
    dense = np.zeros((1800, 4_000))
    for i, c in enumerate(counts):
        dense[i, sorted(c)] = both.weighted(np.array(sorted(c)), np.array([c[t] for t in sorted(c)]))
    assert found[-1][0][0].tolist() == found[-1][1][0].tolist() == []
    for c, sides in list(zip(texts, found, strict=True))[:-1:9]:
        terms = np.array(sorted(c))
        times = np.array([c[t] for t in terms])
        cosines = dense[:, terms] @ both.weighted(terms, times)
        for label, (numbers, near, strong) in enumerate(sides):
            start = ends[0] * label
            assert np.allclose(near, np.sort(cosines[start : ends[label]])[::-1][:15], atol=2e-9) and np.allclose(cosines[numbers], near, atol=2e-9)
            single = alone[label].nearest(terms, times, 15)
            assert single[0].tolist() == (numbers - start).tolist() and single[1].tolist() == near.tolist()
            assert strong.tolist() == [max(signs[label][t] for t in counts[n].keys() & c.keys()) for n in numbers]


def test_copies_and_a_class_without_examples(spark, tables, trained):
    """A batch that holds nothing new is no search; a class may have no examples."""
    docs, _ = tables
    row = docs.where("doc_id = 7").first()
    copies = spark.range(3_000, numPartitions=1).select("id", toxicity.F.lit(row["text"]).alias("text"))
    assert {r["score"] for r in score(copies, trained, "id").collect()} == {score(docs.where("doc_id = 7"), trained).first()["score"]}
    held = pa.table({"doc_id": [1], "copies": [1], "size": pa.array([1], pa.int32()), "terms": [np.int32([0]).tobytes()], "times": [np.int32([1]).tobytes()]})
    side = lambda rows: toxicity.Voters(held.slice(0, rows), np.ones(1), np.zeros(1))
    assert [toxicity.vote((side(a), side(b)), np.array([0]), np.array([1]))[0] for a, b in ((1, 0), (0, 1), (0, 0))] == [0, 1, -1]

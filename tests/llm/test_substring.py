import random
import re
from collections import Counter

import numpy as np
import pytest

from linkweave.llm import substring
from linkweave.llm.substring import FMIndex, WaveletMatrix, drop_repeats, repeated_windows
from tests.llm.samples import DOCUMENTS, collected, edge_documents

COLUMNS = ("doc_id", "n_words", "n_removed", "kept")


def literal(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    count = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (doc_id, _), words in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - 34):
            if count[tuple(words[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        left = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(words) - len(left), " ".join(left)))
    return sorted(out, key=repr)


def sample_rows():
    chosen = random.Random(5)
    word = lambda: f"w{chosen.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90, 200)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(chosen.randrange(5, 90))]
        for _ in range(chosen.randrange(3)):
            part = list(chosen.choice(passages))
            if chosen.random() < 0.5:
                part[chosen.randrange(len(part))] = "edited"
            words += part + [word() for _ in range(chosen.randrange(12))]
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(100, "again " * 50, "en", "s", 0), (101, "one two " * 40, "en", "s", 0), (102, "x " * 34, "en", "s", 0)]
    return rows


@pytest.mark.parametrize("large_from", [1, 4_000])
def test_like_the_literal_definition(spark, monkeypatch, large_from):
    monkeypatch.setattr(substring, "GROUP_SEGMENTS", large_from)
    monkeypatch.setattr(substring, "SHARD_WORDS", 2_000)
    rows = sample_rows()
    assert collected(drop_repeats(spark.createDataFrame(rows, DOCUMENTS)), *COLUMNS) == literal([r[:2] for r in rows])


def test_edge_rows(spark):
    docs = edge_documents(spark).withColumnRenamed("n_chars", "text_hash").withColumnRenamed("lang", "ranges")
    assert collected(drop_repeats(docs), *COLUMNS) == literal([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert drop_repeats(docs.limit(0)).count() == 0


def test_backward_search():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 3000)
    matrix = WaveletMatrix(text, 6)
    for c in range(1, 6):
        low, high = matrix.occurrences(np.array([c]), np.array([100]), np.array([2500]))
        assert high[0] - low[0] == (text[100:2500] == c).sum()
    index = FMIndex(np.append(text, 0))
    for size in (1, 3, 6):
        pattern = text[700 : 700 + size]
        low, high = np.array([0]), np.array([len(text) + 1])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        windows = np.lib.stride_tricks.sliding_window_view(text, size)
        assert high[0] - low[0] == (windows == pattern).all(1).sum()


def test_windows_of_one_shard():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 50, 62).astype(np.uint64), rng.integers(1, 50, 62).astype(np.uint64)
    b[5:45] = a[10:50]
    found = repeated_windows([a, b], np.array([0, 1]))
    assert np.flatnonzero(found[0]).tolist() == [10, 11, 12, 13, 14, 15] and np.flatnonzero(found[1]).tolist() == [5, 6, 7, 8, 9, 10]

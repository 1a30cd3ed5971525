import hashlib

import numpy as np
import pytest

from linkweave.llm import line_dedup
from linkweave.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines, keep_lines
from tests.llm.samples import DOCUMENTS, collected, edge_documents


def literal(rows):
    key = lambda line: line.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda line, d=doc_id: d is not None and len(holders.get(key(line), ())) > 1 and d > min(holders[key(line)])
        left = [line for line in lines if not gone(line)]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept")


def test_edge_rows(spark):
    docs = edge_documents(spark)
    assert collected(dedup_lines(docs), *COLUMNS) == literal([(r["doc_id"], r["text"]) for r in docs.collect()])
    clash = docs.withColumnRenamed("n_chars", "key").withColumnRenamed("lang", "marks")
    left = dedup_lines(clash, carried=["marks", "key"])
    assert left.columns == ["doc_id", "marks", "key", "n_lines", "n_dropped", "kept"]
    assert collected(left, *COLUMNS) == collected(dedup_lines(docs), *COLUMNS)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_hot_lines_in_split_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SPLIT_ROWS", 20)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    rows = [(i, f"everyone has this line\nline number {i % 50} of them\nonly {i} has this one", "en", "s", 0) for i in range(300)]
    assert collected(dedup_lines(spark.createDataFrame(rows, DOCUMENTS)), *COLUMNS) == literal([r[:2] for r in rows])


def test_filter_forgets_only_what_is_deleted():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = CuckooFilter.of(keys)
    assert table.knows(keys).all()
    assert table.knows(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    table.delete(keys[:2500])
    assert table.knows(keys[2500:]).all() and table.knows(keys[:2500]).mean() < 0.01
    assert not CuckooFilter.sized(10).insert(keys)


@pytest.mark.parametrize("room", [1, 100_000])
def test_deleting_documents_brings_lines_back(spark, tmp_path, monkeypatch, room):
    if room == 1:  # filters too small: made anew from the exact table
        monkeypatch.setattr(line_dedup, "FULL", 0.05)
    first = [(i, f"a line that all share\nline of pair {i // 2} here", "en", "s", 0) for i in range(10)]
    second = [(i, f"a line that all share\nline of pair {i // 2} here\nlate line for some", "en", "s", 0) for i in range(9, 14) if i != 9]
    docs = [spark.createDataFrame(rows, DOCUMENTS) for rows in (first, second)]
    index = LineIndex(spark, str(tmp_path / "lines"), shards=3)
    index.insert(docs[0], "1", [])
    index.insert(docs[1], "2", ["1"])
    every = docs[0].union(docs[1])
    state = lambda docs, batches: collected(keep_lines(docs, index.dropped(docs, batches)), *COLUMNS)
    assert state(every, ["1", "2"]) == literal([r[:2] for r in first + second])
    index.delete(spark.createDataFrame([(0,), (10,), (3,)], "doc_id long"), "3", ["1", "2"])
    left = [r for r in first + second if r[0] not in (0, 10, 3)]
    assert state(every.where("doc_id not in (0, 10, 3)"), ["1", "2", "3"]) == literal([r[:2] for r in left])
    index.delete(spark.createDataFrame([(0,), (10,), (3,)], "doc_id long"), "3", ["1", "2"])  # a repeated batch changes nothing
    assert state(every.where("doc_id not in (0, 10, 3)"), ["1", "2", "3"]) == literal([r[:2] for r in left])
    key = hashlib.md5(b"a line that all share").digest()
    shared = {bytes(r["key"]): r["n"] for r in index.shared(["1", "2", "3"]).collect()}
    assert shared[key] == len(left)

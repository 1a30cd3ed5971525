import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm.vector_codes import compress, nearest, sequency_order, walsh

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, error string"


def literal(rows, parts=8, k=16, rounds=6):
    """Sorted (id, code, error, label_error) and the digest, by loops over whole numbers."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(c)))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width = -(-width // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:k]
    firsts = [min(v for i, v, _ in kept if i == wanted) for wanted in ids]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        book = [cut(v, p) for v in firsts]
        mine = [cut(v, p) for _, v, _ in kept]
        near = lambda book=None, mine=mine: [min((sum((a - b) ** 2 for a, b in zip(m, e)), j) for j, e in enumerate(book)) for m in mine]
        for _ in range(rounds):
            found = near(book)
            groups = [[m for m, (_, j) in zip(mine, found) if j == e] for e in range(len(book))]
            book = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, book)]
        for n, (d, j) in enumerate(near(book)):
            codes[n].append(j)
            errors[n] += d
        books += [c for e in book for c in e]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    out = [(i, bytes(c).hex(), e, by_label[label]) for (i, _, label), c, e in zip(kept, codes, errors)]
    return sorted(out, key=repr), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def run(spark, rows):
    table = spark.createDataFrame([(i, v, label, "a", 1, "b") for i, v, label in rows], SCHEMA)
    coded, books = compress(table)
    found = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error").collect()
    return sorted((tuple(r) for r in found), key=repr), books


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16, 32])
def test_coefficients_come_by_sign_changes(size):
    rows = walsh(np.eye(size, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(size))
    assert sorted(sequency_order(size)) == list(range(size))
    x = np.random.default_rng(1).integers(-9, 9, (5, size))
    assert ((walsh(x) ** 2).sum(axis=1) == size * (x**2).sum(axis=1)).all()


def test_nearest_with_ties():
    rng = np.random.default_rng(2)
    for width in (1, 3, 5, 8, 12):
        parts, entries = rng.integers(-3, 4, (400, width)), rng.integers(-3, 4, (7, width))
        entries[5] = entries[2]
        far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        index, distance = nearest(parts, entries)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_equals_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=20).astype(np.float32).tolist(), int(i) % 3 or None) for i in rng.permutation(120)]
    rows += [(7, rows[0][1], 1), (7, rows[0][1], 1), (5, rows[1][1], 9)]
    found, books = run(spark, rows)
    assert (found, books.digest()) == literal(rows)
    code = bytes.fromhex(found[0][1])
    assert len(books.decode(code)) == 24


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [nan] * 8, 1), (3, [1.0, None], 1), (4, [inf] * 8, None), (None, [0.5] * 8, None), (6, [], None), (7, [0.25, -0.25], 2), (None, [0.5] * 8, None)]
    found, books = run(spark, rows)
    assert (found, books.digest()) == literal(rows) and len(found) == 4
    found, books = run(spark, [(1, None, 1)])
    assert found == [] and books.digest() == literal([])[1]
    found, books = run(spark, [(1, [], 1)])
    assert (found, books.digest()) == literal([(1, [], 1)])
    with pytest.raises(ValueError, match="too large"):
        run(spark, [(1, [1e9] * 8, 1)])

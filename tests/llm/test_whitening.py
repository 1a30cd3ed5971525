from fractions import Fraction

import numpy as np
import pytest

from linkweave.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, whitened string, x int, deviation string"


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA)
    found, model = whiten(table, **options)
    return sorted(((r["vec_id"], r["whitened"], int(r["deviation"])) for r in found.collect()), key=repr), model


def literal(rows):
    """Whole rows by id, distinct ones, their exact covariance, and the deviations."""
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    z = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = [[float(Fraction(sum(a[i] * a[j] for a in z), n**3)) for j in range(d)] for i in range(d)]
    return x, n, sums, np.array(cov), [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in x]


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_equals_loops(spark, offset):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix + offset).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1])]
    found, model = run(spark, rows)
    x, n, sums, cov, far = literal(rows)
    assert (model.n, model.sums) == (n, sums) and n == 300
    assert sorted(((i, f) for i, _, f in found), key=repr) == sorted(far, key=repr)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(model.values, values[:4], rtol=1e-12) and np.allclose(model.explained, values[:4] / np.trace(cov), rtol=1e-12)
    for k in range(4):
        v = model.vectors[:, k]
        assert np.allclose(cov @ v, values[k] * v, atol=1e-9 * values[0]) and abs(v @ v - 1) < 1e-12
    by_id = dict(x)
    for i, w, _ in found:
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(by_id[i], sums)])
        assert np.allclose(w, centred @ model.vectors / np.sqrt(values[:4]), atol=1e-9)
    assert model.identity_error < 1e-9


def test_large_components_stay_exact(spark):
    rows = [(1, [3e12, 1.0]), (2, [-3e12, 2.5]), (3, [1.0, -7.0])]
    found, model = run(spark, rows)
    assert [(i, f) for i, _, f in found] == literal(rows)[4]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (None, [0.5, 0.5]), (6, []), (7, [0.25])]
    found, model = run(spark, rows)
    assert model.n == 3 and [i for i, _, _ in found] == [6, 7, None] and all(len(w) == 2 for _, w, _ in found)
    assert run(spark, [(1, None)]) == ([], None)
    found, model = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert found == [(1, [None, None], 0), (2, [None, None], 0)] and model.identity_error is None and model.explained == [None, None]
    found, model = run(spark, [(1, [])])
    assert found == [(1, [], 0)]
    found, model = run(spark, [(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0])])
    assert model.explained == [1.0, 0.0, 0.0] and [w[0] for _, w, _ in found] == [-1.0, 1.0] and found[0][1][1:] == [None, None]

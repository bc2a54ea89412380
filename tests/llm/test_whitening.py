"""Whitening against exact integers and a dense eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, x int"


def brute(rows, scale=256.0):
    """{index of row: [(component, n, deviation, |whitened|, explained)]} of one length."""
    xs = [[math.floor(scale * c) for c in v] for v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    sums = [sum(f[k] for f in fit) for k in range(d)]
    a = np.array([[(n * f[k] - sums[k]) / n for k in range(d)] for f in fit])
    values, basis = np.linalg.eigh(a.T @ a / n)
    order = [k for k in np.argsort(-values) if values[k] > 1e-9 * max(values.max(), 1e-300)][:4]
    out = []
    for x in xs:
        dev = sum((n * x[k] - sums[k]) ** 2 for k in range(d))
        c = np.array([(n * x[k] - sums[k]) / n for k in range(d)])
        out.append([(j + 1, n, dev, abs(float(c @ basis[:, k])) / math.sqrt(values[k]), values[k] / values.sum()) for j, k in enumerate(order)])
    return out


def whitened(spark, rows):
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in enumerate(rows)], SCHEMA)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r.vec_id, []).append(r)
    return {i: sorted(v, key=lambda r: r.component) for i, v in got.items()}


def agree(spark, rows, rel=1e-9):
    got, want = whitened(spark, rows), brute(rows)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert [(r.component, r.n, r.deviation) for r in got[i]] == [x[:3] for x in w]
        for r, x in zip(got[i], w):
            assert math.isclose(abs(r.whitened), x[3], rel_tol=rel, abs_tol=rel)
            assert math.isclose(r.explained, x[4], rel_tol=1e-9) and r.identity_error < 1e-9
    return got


def test_agrees_with_eigh_and_signs_are_the_same_for_all_rows(spark):
    r = np.random.default_rng(1)
    rows = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) / 4).tolist()
    got = agree(spark, rows + rows[:40])
    a, b = (np.array([[x.whitened for x in got[i]] for i in part]) for part in (range(40), range(300, 340)))
    assert np.allclose(a, b, rtol=1e-12, atol=1e-12)
    w = np.array([[x.whitened for x in got[i]] for i in range(300)])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9


def test_fewer_vectors_than_dimensions_and_a_constant_entry(spark):
    r = np.random.default_rng(2)
    agree(spark, r.normal(size=(3, 20)).tolist())
    agree(spark, np.column_stack([r.normal(size=(30, 3)), np.full(30, 0.5)]).tolist())


def test_no_copy_of_an_equal_eigenvalue_is_missed(spark):
    """Axes of equal spread: one Krylov sequence alone finds one direction of them."""
    rows = [[s * (4.0 if k < 3 else 1.0) if k == j else 0.0 for k in range(9)] for j in range(9) for s in (1, -1)]
    got = whitened(spark, rows)
    x = np.array(rows) * 256
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert [round(r.explained, 12) for r in got[0]] == [round(v / values.sum(), 12) for v in values[:4]]
    w = np.array([[r.whitened for r in got[i]] for i in range(len(rows))])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9


def test_large_numbers_keep_their_digits(spark):
    r = np.random.default_rng(3)
    base = 2.0**40
    agree(spark, (base + r.integers(0, 50, size=(60, 5))).tolist(), rel=1e-7)
    huge = whitened(spark, (r.integers(-5, 5, size=(40, 2)) * 2.0**53).tolist())
    assert all(x.deviation is None and math.isfinite(x.whitened) for v in huge.values() for x in v)


def test_rows_that_take_no_part_lengths_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2], "a", 1), (2, None, "a", 1), (3, [], None, 1), (4, [0.5, None], "a", None), (5, [nan, 1.0], "a", 1), (6, [1.0, inf], "a", 1), (7, [1e300, 1.0], "a", 1)]
    rows += [(None, [0.9, -0.3], "b", 2), (8, [0.4, 0.4], "c", 3), (8, [0.4, 0.4], "c", 3), (9, [1.0, 2.0, 3.0], "z", 1), (10, [-0.0, 0.0, 1.0], "z", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted([(i, c, 3) for i in ("1", "None", "8", "8") for c in (1, 2)] + [(i, 1, 2) for i in ("9", "10")])
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], "a", 1)] * 3, SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [24])
def test_every_step_is_one_pass(spark, dim, monkeypatch):
    """The rows are read once a step, and once for the check at the end."""
    passes = []
    plain = whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda *a: passes.append(1) or plain(*a))
    r = np.random.default_rng(4)
    agree(spark, r.normal(size=(200, dim)).tolist())
    assert len(passes) <= 2 * dim + 2

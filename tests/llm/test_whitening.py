"""Exact polynomials, roots and whitening against plain arithmetic."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from eventframe.llm import spectrum, whitening


def faddeev(matrix):
    """Characteristic polynomial by exact fractions."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m = [[Fraction(i == j) for j in range(d)] for i in range(d)]
    c = [Fraction(1)]
    for k in range(1, d + 1):
        am = [[sum(a[i][l] * m[l][j] for l in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(am[i][i] for i in range(d)) / k)
        m = [[am[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(v) for v in c[::-1]]


def gram(rng, d, rank, size):
    x = [[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d, rank, size", [(1, 1, 9), (2, 1, 5), (6, 6, 1000), (7, 3, 10**9), (9, 20, 3), (5, 0, 2)])
def test_characteristic_polynomial(spark, d, rank, size):
    matrix = gram(random.Random(d), d, rank, size)
    assert spectrum.characteristic_polynomial(spark, matrix) == faddeev(matrix)


def test_roots_with_multiplicity():
    # (x - 7)^2 (x - 3) x^2 and one root that is not whole: x^2 - 2
    def times(a, b):
        out = [0] * (len(a) + len(b) - 1)
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                out[i + j] += u * v
        return out
    p = [1]
    for f in ([-7, 1], [-7, 1], [-3, 1], [0, 1], [0, 1], [-2, 0, 1]):
        p = times(p, f)
    roots = spectrum.largest_roots(p, 20, 9)
    got = [float(Decimal(low) * Decimal(2) ** -f) for low, f in roots]
    assert got == pytest.approx([7, 7, 3, 2 ** 0.5], rel=1e-15) and roots[0] == roots[1]


def test_components_of_a_multiple_root(spark):
    matrix = [[5, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0], [0, 0, 0, 0]]
    found = spectrum.principal_components(spark, matrix, 4)
    assert [float(c.eigenvalue) for c in found] == [9.0, 9.0, 5.0]
    v = np.array([c.vector for c in found])
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(v[:2, [0, 3]], 0)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 8)) * np.arange(1, 9) / 3).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in x[0]]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out = whitening.whitened(df).collect()
    whole = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)
    fit = np.unique(whole, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(got) == len(out) == 450 * 4
    for k in range(1, 5):
        want = (whole - total / n) @ vectors[:, -k] / values[-k] ** 0.5
        have = np.array([got[i, k]["whitened"] for i, _ in rows])
        assert np.allclose(have, want, atol=1e-9) or np.allclose(have, -want, atol=1e-9)
        assert got[0, k]["explained"] == pytest.approx(values[-k] / values.sum(), rel=1e-10)
    assert all(r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(whole[i], total)) and r["n"] == n
               for i, (v, _) in enumerate(rows) for r in [got[v, 1]])
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_large_entries_are_exact(spark):
    rng = random.Random(5)
    x = [[rng.randrange(-10**12, 10**12) for _ in range(3)] for _ in range(40)]
    n, total, scatter = whitening.statistics(spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(3), 3)
    assert n == 40 and total == [sum(c) for c in zip(*x)]
    assert scatter == [[40 * sum(r[i] * r[j] for r in x) - total[i] * total[j] for j in range(3)] for i in range(3)]


def test_whitening_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [3.0]), (6, []), (6, [0.5, -2.0])]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<float>, n int, x int")
    out = whitening.whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [(0, 1), (0, 1), (0, 2), (0, 2), (5, 1), (5, 2), (6, 1), (6, 1), (6, 2), (6, 2)]
    assert {r["n"] for r in out} == {4}
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id is null")).count() == 0

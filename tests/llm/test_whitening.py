"""Whitening against NumPy's eigenvectors, its polynomial against determinants, and its edge cases."""

from fractions import Fraction

import numpy as np
import pytest

from metaloom.llm import charpoly, entry, whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def determinant(m):
    m, sign, out = [[Fraction(v) for v in row] for row in m], 1, Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            m[k], m[pivot], sign = m[pivot], m[k], -sign
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return out * sign


def gram(rng, d, n, top):
    a = [[int(v) for v in row] for row in rng.integers(-top, top, (n, d))]
    return [[sum(r[i] * r[j] for r in a) for j in range(d)] for i in range(d)]


def plain(vectors, most=16):
    """(n, deviations, whitened without signs, explained) by NumPy."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, deviation, (x - fit.mean(axis=0)) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    for d, n, top in ((1, 3, 9), (2, 5, 9), (5, 3, 1000), (7, 20, 1 << 40)):
        m = gram(rng, d, n, top)
        poly = charpoly.characteristic_polynomial(spark, m)
        assert poly[d] == 1
        for t in (-3, 0, 5, m[0][0]):
            assert sum(c * t**i for i, c in enumerate(poly)) == determinant([[(t if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])


def test_roots_that_repeat_and_nearly_repeat(spark):
    poly = np.poly1d([1])
    roots = [0, 0, 3, 7, 7, 7, 1000]
    for r in roots:
        poly = poly * np.poly1d([1, -r])
    got = charpoly.largest_roots([int(c) for c in poly.coeffs[::-1]], 16)
    assert [(round(root / 2**shift, 12), n) for root, shift, n in got] == [(1000, 1), (7, 3), (3, 1)]
    near = [[10**30 + 1, 0, 0], [0, 10**30, 0], [0, 0, 1]]  # a gap of 1e-30: parted, and the small root is still exact
    found = charpoly.components(spark, near, 16)
    assert [f[0] for f in found] == [1e30, 1e30, 1.0]
    assert np.allclose(np.abs([f[2] for f in found]), np.eye(3), atol=1e-12)


def test_query_against_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    n, deviation, want, share = plain([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in entry.op13_whitening(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 16 * len(rows)
    assert {r["identity_error"] for r in got.values()}.pop() < 1e-9 and len({r["identity_error"] for r in got.values()}) == 1
    for k in range(16):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in rows])
        assert np.allclose(mine, want[:, k] * np.sign(mine @ want[:, k]), rtol=1e-8, atol=1e-9)
        assert got[rows[0]["vec_id"], k + 1]["explained"] == pytest.approx(share[k], rel=1e-9)
    assert all(got[r["vec_id"], 3]["deviation"] == dev and got[r["vec_id"], 3]["n"] == n for r, dev in zip(rows, deviation, strict=True))


def test_edges(spark):
    rng = np.random.default_rng(2)
    good = [[float(v) for v in row] for row in rng.normal(size=(40, 3)).astype(np.float32)]
    rows = [(i, v, "c") for i, v in enumerate(good)] + [(0, good[0], "c"), (None, good[1], None), (100, good[2], "c")]
    bad = [(200, None, "c"), (201, [1.0, None, 2.0], "c"), (202, [1.0, float("nan"), 2.0], "c"), (203, [1.0, float("-inf"), 2.0], "c"), (204, [], "c"), (205, [1.0, 2.0], "c")]
    got = whitening.whitened(spark.createDataFrame(rows + bad, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    n, deviation, _, share = plain(good)
    assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-12 for r in got)
    assert {r["deviation"] for r in got} == set(deviation)
    assert sum(r["explained"] for r in got if r["vec_id"] == 5) == pytest.approx(1)
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == whitening.whitened(spark.createDataFrame(bad[:5], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame(rows[:1] * 3, SCHEMA)).count() == 0


def test_flat_directions_and_ties(spark):
    points = [(i, [s * (k == 0) * 1.0, s * (k == 1) * 1.0, 0.5], "c") for i, (k, s) in enumerate([(0, 1), (0, -1), (1, 1), (1, -1)])]
    got = whitening.whitened(spark.createDataFrame(points, SCHEMA)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2] and all(r["explained"] == 0.5 and r["identity_error"] < 1e-12 for r in got)


def test_wide_entries_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 4)
    rng = np.random.default_rng(3)
    y = rng.integers(-(1 << 40), 1 << 40, (11, 3))
    assert (whitening._scatter(y) == y.astype(object).T @ y.astype(object)).all()
    rows = spark.createDataFrame([(1, [3e38, 0.0], "c"), (2, [0.0, 1.0], "c"), (3, [5.0, -1.0], "c")], SCHEMA)
    got = whitening.whitened(rows).collect()
    assert all(r["identity_error"] < 1e-4 for r in got) and {r["deviation"] for r in got} == {None}

"""Exact polynomials, roots and components against plain Python and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import whitening
from docketlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_polynomial(matrix):
    """Characteristic polynomial by the trace recurrence, in fractions."""
    d = len(matrix)
    m = [[Fraction(0)] * d for _ in range(d)]
    coefficients = [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += coefficients[-1]
        m = [[sum(matrix[i][j] * m[j][c] for j in range(d)) for c in range(d)] for i in range(d)]
        coefficients.append(-sum(m[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(coefficients)]


@pytest.mark.parametrize("d, size", [(1, 5), (2, 9), (5, 1000), (7, 10 ** 12)])
def test_polynomial(spark, d, size):
    r = random.Random(d)
    half = [[r.randrange(-size, size) for _ in range(d)] for _ in range(max(1, d - 2))]
    scatter = [[sum(row[i] * row[j] for row in half) for j in range(d)] for i in range(d)]
    assert whitening.characteristic_polynomial(spark, scatter) == plain_polynomial(scatter)


def test_polynomial_with_zero_pivots():
    p = 2 ** 31 - 1
    matrix = np.array([[2, 0, 1, 0], [0, 3, 0, 0], [1, 0, 2, 0], [0, 0, 0, 5]], dtype=object)
    assert whitening.hessenberg_polynomial(matrix, p) == [c % p for c in plain_polynomial(matrix.tolist())]


def test_roots_and_repeated_roots():
    # (t - 7)^2 (t - 3) t
    poly = [0, -147, 91, -17, 1]
    assert [whitening.roots_above(poly, a, 0) for a in (-1, 0, 2, 3, 6, 7)] == [4, 3, 3, 2, 2, 0]
    roots = whitening.largest_roots(poly, 17, 4)
    assert [(low + high) / 2 ** (s + 1) for low, high, s in roots] == pytest.approx([7, 7, 3])
    axes = whitening.null_space_components([[7, 0, 0, 0], [0, 3, 0, 0], [0, 0, 7, 0], [0, 0, 0, 0]], roots)
    assert np.abs(axes @ axes.T - np.eye(3)).max() < 1e-12
    assert np.abs(axes[:2, [1, 3]]).max() < 1e-12 and abs(abs(axes[2, 1]) - 1) < 1e-12


@pytest.mark.parametrize("top", [100, 2 ** 31, 2 ** 62])
def test_exact_product(top):
    r = np.random.default_rng(2)
    x = r.integers(-top, top, (50, 4))
    x[0, 0] = -top
    want = x.astype(object).T @ x.astype(object)
    assert (whitening.exact_product(x) == want).all()


def brute(rows, components=4):
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=np.float64)
    n, sums = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for k, v in x.items():
        whole = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
        w = (np.array(v) - sums / n) @ u / np.sqrt(e)
        out.update({(k, i + 1): (n, whole, w[i], e[i] / np.trace(np.cov(fit.T, bias=True))) for i in range(components)})
    return out


def test_registered_query_equals_numpy(spark):
    got = QUERIES["op13_whitened_vectors"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert len(got) == len(want) == 4 * len(rows)
    sign = {}
    for r in got:
        n, whole, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, whole)
        assert r.explained == pytest.approx(share, rel=1e-9)
        s = sign.setdefault(r.component, 1 if w * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(s * w, abs=1e-7)
        assert r.identity_error < 1e-9


def test_unusable_repeated_and_wide_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.0]), (2, None), (3, []), (4, [1.0, nan]), (5, [inf, 0.0]),
            (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.0, 1e6]), (9, [4.0, 1e6])]
    vectors = spark.createDataFrame([(k, v, 1.0, 2) for k, v in rows], "vec_id long, embedding array<double>, whitened double, n int")
    x = whitening.integer_vectors(vectors)
    model = whitening.fit_whitening(x)
    got = sorted((tuple(r) for r in whitening.whiten(x, model).collect()), key=str)
    assert model.n == 4 and len(model.values) == 2
    assert sorted(k for k, c, *_ in got if c == 1 and k) == [1, 1, 8, 9] and sum(k is None for k, *_ in got) == 2
    assert model.identity_error < 1e-6
    fit = [(256, 512), (128, -768), (0, 256_000_000), (1024, 256_000_000)]
    whole = lambda v: sum((4 * a - sum(c)) ** 2 for a, c in zip(v, zip(*fit)))
    assert {r[3] for r in got} == set(map(whole, fit))
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    x = whitening.integer_vectors(huge)
    assert [r.deviation for r in whitening.whiten(x, whitening.fit_whitening(x)).collect()] == [None, None]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_are_no_components(spark, rows):
    x = whitening.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit_whitening(x)
    assert model.values == [] and whitening.whiten(x, model).collect() == []
    assert whitening.whiten(x, model).columns[0] == "vec_id"


def test_partial_sums_over_many_tasks(spark):
    r = np.random.default_rng(1)
    data = r.integers(-5, 6, (300, 3))
    x = spark.createDataFrame([(v.tolist(),) for v in data], "x array<long>").repartition(7).select(F.col("x"))
    n, sums, products = whitening.integer_moments(x, 3)
    assert n == 300 and sums == data.sum(axis=0).tolist() and products == (data.T @ data).tolist()

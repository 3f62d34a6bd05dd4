import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm.common import table
from tamarack.llm.queries import QUERIES
from tamarack.llm.whitening import Whitening, eigen, fit, product, whiten

SCHEMA = "vec_id long, embedding array<double>"


def turned(values, seed=0):
    """A symmetric matrix of these eigenvalues, and its eigenvectors, in extended precision."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ ((np.eye(d) - q.T @ q) / 2)
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


def plain_grid(vectors):
    return {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in vectors}


def plain_whitened(grid, k=16):
    """n, deviations, whitened and explained shares by exact fractions and numpy's eigenvectors."""
    known = sorted(set(grid.values()))
    n, d = len(known), len(known[0])
    sums = [sum(x[j] for x in known) for j in range(d)]
    y = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for x in known])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    values, vectors, trace = values[order], vectors[:, order], values.sum()
    rows = {x: (w, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for x, w in zip(known, y @ vectors / np.sqrt(values))}
    return n, rows, values / trace


@pytest.mark.parametrize("values", [np.linspace(1, 9, 20), np.logspace(-6, 0, 20), [5.0] * 4 + list(np.linspace(1, 4, 16)), 1 + np.arange(20) * 1e-9, [2 + 1e-13, 2.0, 1.0]])
def test_eigenvectors(values):
    a, q = turned(values)
    found, x = eigen(a)
    long = x.astype(np.longdouble)
    assert np.abs(found - np.sort(np.array(values))[::-1]).max() <= 4e-16 * max(values)
    assert np.abs(a @ long - long * found).max() <= 4e-16 * max(values) and np.abs(long.T @ long - np.eye(len(a))).max() <= 2e-16
    gaps = np.array([min([abs(v - w) for j, w in enumerate(values) if j != i]) for i, v in enumerate(values)]) / max(values)
    for i in np.flatnonzero(gaps > 1e-4):
        j = np.argmin(np.abs(found - values[i]))
        assert min(np.abs(q[:, i] - long[:, j]).max(), np.abs(q[:, i] + long[:, j]).max()) < 1e-15


def test_product_is_extended():
    rng = np.random.default_rng(1)
    a, b = (rng.standard_normal((30, 30)).astype(np.longdouble) / 3 * np.exp2(rng.integers(-20, 20, (30, 1))) for _ in range(2))
    assert np.abs(product(a, b) / (a @ b) - 1).max() < 1e-15
    unit, q = turned(np.ones(30))
    assert np.abs(product(q, q.T) - np.eye(30)).max() < 1e-18


def test_query_against_plain(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    grid = plain_grid([v for v in vectors if v[1] is not None])
    n, rows, explained = plain_whitened(grid)
    found = QUERIES["op12_whitening"](spark, sf_dir).collect()
    assert len(found) == len(grid) * 16 and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    signs = {c: np.sign(sum(r.whitened * rows[grid[r.vec_id]][0][c - 1] for r in found if r.component == c)) for c in range(1, 17)}
    for r in found:
        w, deviation = rows[grid[r.vec_id]]
        assert r.deviation == deviation and abs(r.explained - explained[r.component - 1]) < 1e-12
        assert abs(r.whitened - signs[r.component] * w[r.component - 1]) < 1e-7


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.standard_normal(4)]) for i in range(40)]
    rows = [*good, good[0], (None, good[1][1]), (90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [float("nan")] * 4), (94, [1.0, 2.0, 3.0, float("inf")]), (95, [1.0]), (96, [1e300] * 4)]
    vectors = spark.createDataFrame([(i, v, i, "k") for i, v in rows], "vec_id long, embedding array<double>, Whitened long, grid string").repartition(3)
    model = fit(vectors)
    out = whiten(vectors, model)
    assert out.columns == ["vec_id", "embedding", "Whitened", "grid", "deviation", "whitened_"]
    got = out.collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1) for r in got) == sorted([-1, 0, *range(40)])
    n, plain, explained = plain_whitened(plain_grid(good), 4)
    assert model.n == n == 40 and np.abs(model.explained - explained).max() < 1e-12 and model.identity_error < 1e-12
    assert all(int(r.deviation) == plain[plain_grid([(0, r.embedding)])[0]][1] for r in got)
    assert len({tuple(r.whitened_) for r in got if r.embedding == good[0][1]}) == 1
    again = whiten(vectors.repartition(7), fit(vectors.repartition(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # sums are exact: the order of rows is nothing


def test_no_variance_and_no_rows(spark):
    none = spark.createDataFrame([(1, None)], SCHEMA)
    assert fit(none) is None and whiten(none, None).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    model = fit(same)
    assert model.n == 1 and [(r.deviation, r.whitened) for r in whiten(same, model).collect()] == [(0, []), (0, [])]
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], SCHEMA)  # one dimension is constant
    model = fit(flat)
    assert len(model.values) == 1 and abs(model.explained[0] - 1) < 1e-15 and model.identity_error < 1e-14
    assert fit(flat.where("vec_id < 0")) is None


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(i) * 2.0**40, -float(i % 7) * 2.0**45 + 0.25]) for i in range(30)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    model = fit(vectors)
    grid = plain_grid(rows)
    n, plain, explained = plain_whitened(grid, 2)
    got = whiten(vectors, model).collect()
    assert all(int(r.deviation) == plain[grid[r.vec_id]][1] for r in got if r.deviation is not None)
    assert np.abs(model.explained - explained).max() < 1e-9 and model.identity_error < 1e-9
    far = Whitening(10**9, 1, np.array([0]), np.array([10**9 - 1]), np.ones(1), np.ones((1, 1)), np.ones(1))
    assert far.deviations(np.array([[10**12]])) == [(10**9 * 10**12 - (10**9 - 1)) ** 2]


def test_one_vector_on_a_third_of_the_rows(spark):
    rows = spark.range(3_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.sin("id"), F.cos(F.col("id") * 2))).alias("embedding"))
    assert fit(rows).n == len(set(plain_grid([(r.vec_id, r.embedding) for r in rows.collect()]).values()))

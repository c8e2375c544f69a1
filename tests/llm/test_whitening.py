"""Exact whitening against rational arithmetic and floating-point decompositions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import whitening
from quayside.llm.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def determinant(matrix):
    rows, sign, product = [[Fraction(v) for v in row] for row in matrix], 1, Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            rows[k], rows[pivot], sign = rows[pivot], rows[k], -sign
        product *= rows[k][k]
        for i in range(k + 1, len(rows)):
            factor = rows[i][k] / rows[k][k]
            rows[i] = [a - factor * b for a, b in zip(rows[i], rows[k])]
    return sign * product


def scatter_of(rows):
    n, size = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(size)]
    return [[n * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(size)] for i in range(size)]


def test_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors.items()}
    n, size = len(x), 64
    sums = [sum(v[k] for v in x.values()) for k in range(size)]
    assert len(rows) == 32 * n and {(r.vec_id, r.component) for r in rows} == {(i, k + 1) for i in x for k in range(32)}
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    assert all(r.deviation == exact[r.vec_id] and r.n == n for r in rows)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x[i], sums)] for i in sorted(x)])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:32], directions[:, ::-1][:, :32]
    white = np.zeros((n, 32))
    at = {i: k for k, i in enumerate(sorted(x))}
    for r in rows:
        white[at[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / (centred**2).sum() * n, rel=1e-9)
    expected = centred @ directions / np.sqrt(values)
    assert np.abs(white - expected * np.sign((white * expected).sum(axis=0))).max() < 1e-8
    (error,) = {r.identity_error for r in rows}
    assert error < 1e-12 and np.abs(white.T @ white / n - np.eye(32)).max() == pytest.approx(error, abs=1e-13)


@pytest.mark.parametrize("size", [1, 2, 3, 6, 9])
def test_polynomial_is_exact(spark, size):
    rng = random.Random(size)
    rows = [[rng.randrange(-(10**6), 10**6) for _ in range(size)] for _ in range(size + 3)]
    if size > 3:  # sparse and equal columns, so that pivots vanish
        rows = [[0 if k in (1, 4) else r[0] if k == 2 else v for k, v in enumerate(r)] for r in rows]
    scatter = scatter_of(rows)
    found = whitening.characteristic_polynomial(spark, scatter)
    assert len(found) == size + 1 and found[-1] == 1
    for point in range(-2, size):
        shifted = [[(point if i == j else 0) - v for j, v in enumerate(row)] for i, row in enumerate(scatter)]
        assert sum(c * point**k for k, c in enumerate(found)) == determinant(shifted)


def test_products_of_any_size_are_exact():
    rng = random.Random(2)
    for bits in (3, 19, 20, 21, 40, 61):
        y = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], np.int64)
        expected = y.astype(object).T @ y.astype(object)
        assert (whitening.exact_products(y) == expected).all()


def test_equal_and_close_roots():
    """Roots 9, 9, 9 + 2**-90 (scaled up), 4, 0: counted, isolated and with orthonormal spaces."""
    scale = 1 << 90
    roots = [9 * scale + 1, 9 * scale, 9 * scale, 4 * scale]
    polynomial = [1]
    for r in roots:
        polynomial = [a - r * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert [whitening.roots_above(polynomial, at, 0) for at in (0, 4 * scale, 9 * scale - 1, 9 * scale, 9 * scale + 1)] == [4, 3, 3, 1, 0]
    found = [whitening.isolated_root(polynomial, k) for k in (1, 2, 3, 4)]
    assert [(r.first, r.count) for r in found] == [(1, 1), (2, 2), (2, 2), (4, 1)]
    for root, value in zip(found, roots):
        assert root.low < value << root.shift <= root.low + 1
    matrix = [[r if i == j else 0 for j in range(4)] for i, r in enumerate(roots)]
    assert np.abs(whitening.null_space(matrix, found[0])[0]) == pytest.approx([1, 0, 0, 0])
    pair = np.array(whitening.null_space(matrix, found[1]))
    assert pair @ pair.T == pytest.approx(np.eye(2), abs=1e-15) and np.abs(pair[:, [0, 3]]).max() < 1e-15


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, whitened string")


def test_cases(spark):
    """Nulls, lengths, entries that aren't finite, repeated rows, equal eigenvalues, constant directions."""
    steps = [[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 0], [0, 0, 0]]
    good = [(i, [a / 64 for a in v] + [5.0], 1, "x") for i, v in enumerate(steps)]
    bad = [(10, None, 1, "x"), (11, [1.0, None, 2.0, 3.0], 1, "x"), (12, [float("nan"), 1.0, 1.0, 1.0], 1, "x"),
           (13, [float("-inf"), 1.0, 1.0, 1.0], 1, "x"), (14, [], 1, "x"), (15, [9.0], 1, "x")]
    rows = whitening.whitened(vectors_of(spark, [*good, (None, good[0][1], 1, "x"), (1, good[1][1], 1, "x"), *bad])).collect()
    assert sorted((r.vec_id for r in rows), key=str) == [0, 1, 1, 2, 3, 4, 5, None]
    assert {r.n for r in rows} == {8} and all(len(r.whitened) == 2 for r in rows)
    assert rows[0].explained == pytest.approx([4 / 6, 2 / 6]) and {r.identity_error for r in rows}.pop() < 1e-14
    assert {r.vec_id: int(r.deviation) for r in rows} == {0: 64, None: 64, 1: 64, 2: 64, 3: 64, 4: 0, 5: 0}
    equal = whitening.whitened(vectors_of(spark, good)).collect()  # both directions have the same variance
    white = np.array([r.whitened for r in equal])
    assert white.T @ white / 6 == pytest.approx(np.eye(2), abs=1e-14) and equal[0].explained == pytest.approx([0.5, 0.5])
    assert whitening.whitened(vectors_of(spark, [good[0]] * 3)).count() == 0
    assert whitening.whitened(vectors_of(spark, bad[:5])).count() == 0
    nothing = whitening.whitened(vectors_of(spark, []))
    assert nothing.count() == 0 and nothing.columns[0] == "vec_id"


def test_large_entries(spark):
    """Beyond what doubles and 64 bits hold, sums and deviations stay exact."""
    rng = random.Random(3)
    values = [[float(rng.randrange(-(1 << 50), 1 << 50)) for _ in range(3)] for _ in range(20)]
    documents = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(documents.repartition(3)).collect()
    y = [[int(64 * c) for c in v] for v in values]
    sums = [sum(c) for c in zip(*y)]
    assert {r.vec_id: int(r.deviation) for r in rows} == {
        i: sum((20 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(y)}
    vectors, size = whitening.usable(documents, "embedding", ["vec_id"])
    assert whitening.moments(vectors, size).scatter == scatter_of(y)
    beyond = documents.withColumn("embedding", F.transform("embedding", lambda c: c * 1e200))
    assert beyond.count() == len(whitening.whitened(beyond).collect())

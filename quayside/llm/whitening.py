"""Whitening of embeddings by exact principal components.

Entries are taken as whole 64ths, so the scatter matrix of all vectors, n times their sum of products
less the product of their sums, is a matrix of integers and known exactly. Its eigenvalues are the roots of
its characteristic polynomial:

* tasks find the polynomial modulo one prime each, from a Hessenberg form; as many primes as a bound on
  the coefficients asks for are put together by Chinese remaindering on the driver;
* all roots are real, so the sign changes of the polynomial shifted by ``a`` are exactly the roots above
  ``a``. That isolates the root of each component, which halving refines to ``BITS`` bits;
* a component is the null space of the matrix less its eigenvalue, by inverse iteration in numbers
  of that precision. Roots that agree in ``EQUAL_BITS`` bits share a space, of which an orthonormal basis is taken.

One task finds one component. What goes to the driver and to all tasks depends on the number of
dimensions alone. All components of a constant direction (eigenvalue 0) are left out, as they can't be scaled.

Defined results: vectors that are NULL or hold a NULL or an entry that isn't finite are dropped, empty ones
too; of several lengths the most frequent (of these, the largest) is taken and the others are dropped; entries beyond
2**55 count as that; repeated rows count each; NULL ids stay; an empty table, and vectors that are all the same,
give no rows; other columns are ignored unless in ``keep``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import table

COMPONENTS = 32
STEPS = 64  # whole steps of an entry to 1
OFFSET = 1_000_000  # of the reported numbers; neither scatter nor deviation depends on it
LARGEST = float(1 << 61)
LIMB, LIMBS, ROWS = 20, 4, 4096  # products of 20-bit limbs of so many rows add up exactly in doubles
PART = 30  # bits of the parts whose sums Spark adds up
PRIME_BITS = 31
PRIMES_A_TASK = 8
BITS = 256
EQUAL_BITS = 128


class Moments(NamedTuple):
    """Number of vectors, their sums, and their exact scatter n * sum(y y') - sum(y) sum(y)'."""

    n: int
    sums: list[int]
    scatter: list[list[int]]


class Component(NamedTuple):
    variance: float  # of the numbers, divisor n
    explained: float
    direction: list[float]


class Whitening(NamedTuple):
    moments: Moments
    components: list[Component]


# --- moments ------------------------------------------------------------------------------


def whole_steps(values: np.ndarray) -> np.ndarray:
    """Entries as whole steps; doubles hold the product exactly."""
    return np.clip(np.floor(values * STEPS), -LARGEST, LARGEST).astype(np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return whole_steps(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers: products of limbs are exact in doubles."""
    limbs, rest = [], y
    while len(limbs) < LIMBS and np.any((rest < -(1 << LIMB - 1)) | (rest >= 1 << LIMB - 1)):
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _parts(cell: int, value: int) -> Iterator[tuple[int, int, int]]:
    """Signed parts of a number, each small enough that sums of very many stay whole."""
    sign, left, place = (1 if value > 0 else -1), abs(value), 0
    while left:
        yield cell, place, sign * (left & ((1 << PART) - 1))
        left >>= PART
        place += 1


def moments(vectors: DataFrame, size: int) -> Moments:
    """Exact moments of ``size`` dimensions of the whole column ``vector``."""

    def run(batches):
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            y = _matrix(batch.column(0), size)
            for start in range(0, len(y), ROWS):
                block = y[start : start + ROWS]
                n += len(block)
                sums += np.array([sum(column) for column in block.T.tolist()], object)
                products += exact_products(block)
        rows = list(_parts(0, n))
        for i in range(size):
            rows += _parts(1 + i, sums[i])
            for j in range(i, size):
                rows += _parts(1 + size + i * size + j, products[i, j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["cell", "place", "part"])

    parts = vectors.select("vector").mapInArrow(run, "cell bigint, place bigint, part bigint")
    found: dict[int, int] = {}
    for cell, place, part in parts.groupBy("cell", "place").agg(F.sum("part")).collect():
        found[cell] = found.get(cell, 0) + (part << PART * place)
    n, sums = found.get(0, 0), [found.get(1 + i, 0) for i in range(size)]
    scatter = [[0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i, size):
            scatter[i][j] = scatter[j][i] = n * found.get(1 + size + i * size + j, 0) - sums[i] * sums[j]
    return Moments(n, sums, scatter)


# --- characteristic polynomial ------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Strong tests to the bases that settle all numbers below 2**64."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Largest primes of ``PRIME_BITS`` bits whose product is beyond twice the bound."""
    found, product, candidate = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound:
        if is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def coefficient_bound(scatter: list[list[int]]) -> int:
    """No coefficient is larger: the eigenvalues aren't negative and add up to the trace (Maclaurin)."""
    size = len(scatter)
    mean = -(-sum(scatter[i][i] for i in range(size)) // size) if size else 0
    return max((math.comb(size, k) * mean**k for k in range(size + 1)), default=1)


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime, from the constant up, by way of a Hessenberg form."""
    a, size = matrix.copy(), len(matrix)
    for k in range(size - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(axis=1)) % p
    polynomials = np.zeros((size + 1, size + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(size):
        polynomials[k + 1, 1:] = polynomials[k, :-1]
        weights, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * product % p
            product = product * int(a[i, i - 1]) % p if i else product
        taken = (weights[:, None] * polynomials[: k + 1] % p).sum(axis=0)
        polynomials[k + 1] = (polynomials[k + 1] - taken) % p
    return polynomials[size].tolist()


def characteristic_polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - scatter), from the constant up; one prime at a time in the tasks."""
    primes = primes_for(coefficient_bound(scatter))

    def run(batches):
        for batch in batches:
            for p in batch.column("prime").to_pylist():
                matrix = np.array([[value % p for value in row] for row in scatter], np.int64)
                yield pa.RecordBatch.from_pydict({"prime": [p], "coefficients": [polynomial_modulo(matrix, p)]})

    tasks = -(-len(primes) // PRIMES_A_TASK)
    rows = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks)
    total, product = None, 1
    for p, coefficients in sorted(tuple(r) for r in rows.mapInArrow(run, "prime bigint, coefficients array<bigint>").collect()):
        inverse = pow(product, -1, p)
        if total is None:
            total = [0] * len(coefficients)
        total = [t + product * ((c - t) * inverse % p) for t, c in zip(total, coefficients)]
        product *= p
    return [t - product if 2 * t > product else t for t in total]


# --- roots and components -----------------------------------------------------------------


class Root(NamedTuple):
    """The root lies in (low, low + 1] of 2**-shift; ``first`` to ``first + count - 1`` are as good as equal."""

    low: int
    shift: int
    first: int
    count: int


def roots_above(polynomial: list[int], at: int, shift: int) -> int:
    """How many roots exceed at / 2**shift: sign changes of the shifted polynomial, as all are real."""
    size = len(polynomial) - 1
    scaled = [c << shift * (size - k) for k, c in enumerate(polynomial)]
    for first in range(size):  # coefficients in x + at
        for k in range(size - 1, first - 1, -1):
            scaled[k] += at * scaled[k + 1]
    signs = [c > 0 for c in scaled if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(polynomial: list[int], at: int, shift: int) -> int:
    total, size = 0, len(polynomial) - 1
    for k in range(size, -1, -1):
        total = total * at + (polynomial[k] << shift * (size - k))
    return total


def isolated_root(polynomial: list[int], number: int) -> Root:
    """The ``number``-th largest root, to ``BITS`` bits; all roots are real and this one is positive."""
    high = 1 << max(1, (-polynomial[-2]).bit_length())  # the sum of the roots is not less than any
    low, shift, above_low, above_high = 0, 0, roots_above(polynomial, 0, 0), 0
    while above_low - above_high > 1:
        if high - low == 1:
            if high.bit_length() >= EQUAL_BITS:
                break
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        above = roots_above(polynomial, middle, shift)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    first, count = above_high + 1, above_low - above_high
    while True:
        if high - low == 1:
            if high.bit_length() >= BITS or count > 1:
                break
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        value = _value(polynomial, middle, shift)
        # Between this root and the next smaller one the sign is that of (-1)**number.
        if value and (value > 0) == (number % 2 == 0):
            low = middle
        else:
            high = middle
    return Root(low, shift, first, count)


def null_space(scatter: list[list[int]], root: Root) -> list[list[float]]:
    """Orthonormal directions that belong to a root, by inverse iteration."""
    extra = max(0, BITS - max(1, root.low.bit_length()))
    size, low = len(scatter), root.low << extra
    work = np.array([[value << root.shift + extra for value in row] for row in scatter], object)
    work[np.arange(size), np.arange(size)] -= low
    factors, order = np.zeros((size, size), object), list(range(size))
    for k in range(size):
        pivot = max(range(k, size), key=lambda i: abs(work[i, k]))
        work[[k, pivot]], factors[[k, pivot]] = work[[pivot, k]], factors[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if work[k, k] == 0:
            work[k, k] = 1
        if k + 1 < size:
            factors[k + 1 :, k] = (work[k + 1 :, k] << BITS) // work[k, k]
            work[k + 1 :, k + 1 :] -= np.outer(factors[k + 1 :, k], work[k, k + 1 :]) >> BITS
    rng = random.Random(root.first)
    one, basis = 1 << BITS, []
    for _ in range(root.count):
        vector = np.array([rng.randrange(-one, one) for _ in range(size)], object)
        for _ in range(3):
            for known in basis:
                vector = vector - (known * (known @ vector >> BITS) >> BITS)
            solved = vector[order]
            for k in range(size - 1):
                solved[k + 1 :] -= factors[k + 1 :, k] * solved[k] >> BITS
            for k in range(size - 1, -1, -1):
                rest = solved[k] - (work[k, k + 1 :] @ solved[k + 1 :] >> BITS if k + 1 < size else 0)
                solved[k] = (rest << BITS) // work[k, k]
            largest = max(abs(v) for v in solved) or 1
            vector = np.array([(v << BITS) // largest for v in solved], object)
        for known in basis:
            vector = vector - (known * (known @ vector >> BITS) >> BITS)
        length = math.isqrt(vector @ vector) or 1
        basis.append(np.array([(v << BITS) // length for v in vector], object))
    return [[v / one for v in vector] for vector in basis]


def components(spark: SparkSession, found: Moments, count: int = COMPONENTS) -> list[Component]:
    """Up to ``count`` components by falling eigenvalue, each found by a task; eigenvalue 0 has none."""
    polynomial = characteristic_polynomial(spark, found.scatter)
    while polynomial and polynomial[0] == 0:
        polynomial = polynomial[1:]
    positive, scatter, n = len(polynomial) - 1, found.scatter, found.n
    if positive < 1:
        return []
    trace = sum(scatter[i][i] for i in range(len(scatter)))

    def run(batches):
        for batch in batches:
            for number in batch.column("number").to_pylist():
                root = isolated_root(polynomial, number)
                direction = null_space(scatter, root)[number - root.first]
                twice, unit = 2 * root.low + 1, 1 << root.shift + 1
                yield pa.RecordBatch.from_pydict({
                    "number": [number], "variance": [twice / (unit * n * n)], "explained": [twice / (unit * trace)],
                    "direction": [direction]})

    wanted = min(count, positive)
    numbers = spark.createDataFrame([(k + 1,) for k in range(wanted)], "number bigint").repartitionByRange(wanted, "number")
    rows = numbers.mapInArrow(run, "number bigint, variance double, explained double, direction array<double>").collect()
    return [Component(r.variance, r.explained, list(r.direction)) for r in sorted(rows, key=lambda r: r.number)]


# --- whitened vectors ---------------------------------------------------------------------


def usable(embeddings: DataFrame, vector_column: str, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with a whole vector (columns _0, _1, ... of ``keep``, and vector), and its length."""
    vector = F.col(vector_column).cast("array<double>")
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
    rows = embeddings.where(whole & (F.size(vector) > 0)).select(
        *[F.col(name).alias(f"_{i}") for i, name in enumerate(keep)], vector.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    size = common["length"] if common else 0
    return rows.where(F.size("vector") == size), size


def fit(spark: SparkSession, vectors: DataFrame, size: int, count: int = COMPONENTS) -> Whitening:
    """Moments and components of the column ``vector``."""
    found = moments(vectors, size)
    return Whitening(found, components(spark, found, count) if found.n else [])


def _centred(y: np.ndarray, found: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Vectors less the whole part of the mean, exact, and what is left of each sum."""
    whole = np.array([s // found.n for s in found.sums], np.int64)
    return y - whole, np.array([s % found.n for s in found.sums], object)


def _projected(apart: np.ndarray, rest: np.ndarray, fitted: Whitening) -> np.ndarray:
    directions = np.array([c.direction for c in fitted.components])
    scale = np.sqrt([c.variance for c in fitted.components])
    return (apart - rest.astype(np.float64) / fitted.moments.n) @ directions.T / scale


def deviations(apart: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Sum of (n * x - S)**2 per vector, exact."""
    if apart.size and int(np.abs(apart).max()) * max(1, int(max(rest))) * apart.shape[1] < 1 << 62 and (
            int(np.abs(apart).max()) ** 2 * apart.shape[1] < 1 << 62):
        squares = (apart * apart).sum(axis=1).astype(object)
        mixed = (apart @ rest.astype(np.int64)).astype(object)
    else:
        squares = (apart.astype(object) ** 2).sum(axis=1)
        mixed = apart.astype(object) @ rest
    return list(n * n * squares - 2 * n * mixed + int(rest @ rest))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, from the vectors themselves."""
    count, n = len(fitted.components), fitted.moments.n

    def run(batches):
        sums, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            apart, rest = _centred(_matrix(batch.column(0), len(fitted.moments.sums)), fitted.moments)
            white = _projected(apart, rest, fitted)
            sums += white.sum(axis=0)
            products += white.T @ white
        values = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "value"])

    cells = vectors.select("vector").mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value"))
    values = np.array([value for _, value in sorted(tuple(r) for r in cells.collect())]) / n
    mean, products = values[:count], values[count:].reshape(count, count)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(count)).max())


def whitened(
    embeddings: DataFrame, count: int = COMPONENTS, keep: Sequence[str] = ("vec_id",), vector_column="embedding",
) -> DataFrame:
    """One row per whole vector: ``keep``, n, deviation, whitened, explained and identity_error.

    ``whitened`` and ``explained`` are arrays by component; ``deviation`` is NULL beyond 38 digits.
    """
    spark = embeddings.sparkSession
    vectors, size = usable(embeddings, vector_column, keep)
    fitted = fit(spark, vectors, size, count)
    found = fitted.moments
    schema = T.StructType([
        *vectors.drop("vector").schema.fields,
        *T.StructType.fromDDL("n bigint, deviation decimal(38,0), whitened array<double>").fields])
    if fitted.components:
        error = identity_error(vectors, fitted)
    else:
        vectors, error = vectors.where(F.lit(False)), 0.0
    explained = F.array(*[F.lit(c.explained) for c in fitted.components]).cast("array<double>")

    def run(batches):
        for batch in batches:
            apart, rest = _centred(_matrix(batch.column("vector"), size), found)
            white = _projected(apart, rest, fitted)
            exact = [Decimal(d) if d < 10**38 else None for d in deviations(apart, rest, found.n)]
            offsets = np.arange(len(white) + 1, dtype=np.int32) * len(fitted.components)
            yield pa.RecordBatch.from_arrays([
                *batch.drop_columns("vector").columns, pa.array([found.n] * len(white), pa.int64()),
                pa.array(exact, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
            ], schema.names)

    rows = vectors.mapInArrow(run, schema)
    return rows.select(
        *[F.col(f"_{i}").alias(name) for i, name in enumerate(keep)], "n", "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark, folder: str) -> DataFrame:
    """Up to 32 whitened components of every embedding."""
    rows = whitened(table(spark, folder, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    return rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", parts).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")

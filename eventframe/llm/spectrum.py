"""Largest eigenvalues and eigenvectors of an integer covariance scatter by way of its exact characteristic polynomial.

The polynomial's coefficients are integers of known size, so they follow from their residues modulo enough primes: per
prime the matrix is brought to Hessenberg form over the field, where the polynomial is a short recurrence, and the residues
are put together by Chinese remaindering. All roots are real, so Descartes' rule counts them exactly: the number of roots
above t is the number of sign changes of the coefficients after a shift by t. Bisection on that count isolates each root to
the precision wanted, multiple roots included. A component is a null vector of the matrix less the root, by inverse iteration in
long decimals; components of one multiple root are made orthogonal to each other.

Everything here is as large as the matrix, not as the data; the residues are tasks of a Spark job.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

Matrix = list[list[int]]
BITS = 130          # relative precision of a root
DIGITS = 120        # decimal digits of the inverse iteration
RESIDUAL = Decimal("1e-30")


def is_prime(n: int) -> bool:
    """Exact below 3.3 * 10^24 (the first twelve primes as Miller-Rabin bases)."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % p == 0 for p in small):
        return n in small
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in small:
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, from the largest on, whose product exceeds ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def residues(matrix: Matrix, p: int) -> list[int]:
    """Coefficients, constant first, of det(x - matrix) modulo the prime."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
    d = len(h)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u[None, :] % p).sum(axis=1)) % p
    chain = [np.array([1], np.int64)]       # chain[k]: the polynomial of the leading k rows and columns
    for k in range(1, d + 1):
        new = np.zeros(k + 1, np.int64)
        new[1:] = chain[k - 1]
        new[:-1] = (new[:-1] - h[k - 1, k - 1] * chain[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            new[:i] = (new[:i] - int(h[i - 1, k - 1]) * below % p * chain[i - 1]) % p
        chain.append(new)
    return [int(c) for c in chain[d] % p]


def remaindered(found: dict[int, list[int]]) -> list[int]:
    """The integers of least size with the given residues."""
    product = 1
    for p in found:
        product *= p
    size = len(next(iter(found.values())))
    out = [0] * size
    for p, rest in found.items():
        others = product // p
        unit = others * pow(others % p, -1, p)
        for k in range(size):
            out[k] += rest[k] * unit
    return [c - product if (c := v % product) * 2 > product else c for v in out]


def characteristic_polynomial(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Exact coefficients, constant first, of a symmetric integer matrix without negative eigenvalues."""
    d = len(matrix)
    if d == 0:
        return [1]
    trace = sum(matrix[i][i] for i in range(d))
    # A coefficient is a symmetric function of the eigenvalues, largest when they are equal.
    bound = max(comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))
    primes = primes_for(4 * bound)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([residues(matrix, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, len(primes) // 16)).mapInArrow(solve, "p long, c array<long>")
    return remaindered({r["p"]: r["c"] for r in rows.collect()})


def above(polynomial: list[int], t: int) -> int:
    """How many roots, counted with multiplicity, are larger than t; all roots must be real."""
    c = polynomial[::-1]
    for stop in range(len(c) - 1, 0, -1):       # Taylor shift by repeated synthetic division
        for i in range(1, stop + 1):
            c[i] += t * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def largest_roots(polynomial: list[int], trace: int, count: int) -> list[tuple[int, int]]:
    """(root rounded down, f) in units of 2^-f, of the largest positive roots, falling, multiple ones repeated."""
    d = len(polynomial) - 1
    positive = above(polynomial, 0)
    out: list[tuple[int, int]] = []
    for k in range(1, min(count, positive) + 1):
        if out and above(_scaled(polynomial, out[-1][1]), out[-1][0]) >= k:
            out.append(out[-1])     # it lies in the interval of the one before: equal to BITS bits
            continue
        f, low, high = 0, 0, trace + 1
        scaled = polynomial
        while True:
            while high - low > max(1, low >> BITS):
                middle = (low + high) // 2
                low, high = (middle, high) if above(scaled, middle) >= k else (low, middle)
            if low >> BITS:
                break
            more = BITS + 1 - low.bit_length() if low else 2 * f + d + BITS
            f, low, high = f + more, low << more, high << more
            scaled = _scaled(polynomial, f)
        out.append((low, f))
    return out


def _scaled(polynomial: list[int], f: int) -> list[int]:
    """The polynomial whose roots are 2^f times as large."""
    d = len(polynomial) - 1
    return [c << f * (d - k) for k, c in enumerate(polynomial)]


@dataclass(frozen=True)
class Component:
    eigenvalue: Decimal
    vector: tuple[float, ...]


def _factored(matrix: Matrix, root: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU factors with partial pivoting of matrix - root; a vanishing pivot becomes a tiny one."""
    d = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
    tiny = (abs(root) + 1).scaleb(-DIGITS + 10)
    for i in range(d):
        a[i, i] -= root
    order = list(range(d))
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[i], order[k] = order[k], order[i]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        if k + 1 < d:
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def _solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order].copy()
    for i in range(1, len(x)):
        x[i] -= lu[i, :i] @ x[:i]
    for i in range(len(x) - 1, -1, -1):
        x[i] = (x[i] - (lu[i, i + 1:] @ x[i + 1:] if i + 1 < len(x) else 0)) / lu[i, i]
    return x


def null_vectors(matrix: Matrix, root: Decimal, count: int) -> list[np.ndarray]:
    """Unit vectors, orthogonal to each other, that matrix - root sends to zero; ``count`` is the root's multiplicity."""
    a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(len(matrix), len(matrix))
    lu, order = _factored(matrix, root)
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    for _ in range(count):
        x = np.array([Decimal(int(v)) for v in rng.integers(1, 1 << 30, len(matrix))], object)
        for _ in range(40):
            x = _solve(lu, order, x)
            for v in found:
                x = x - (v @ x) * v
            x = x / (x @ x).sqrt()
            gap = a @ x - root * x
            if (gap @ gap).sqrt() <= RESIDUAL * abs(root):
                break
        else:
            raise ArithmeticError("inverse iteration did not converge")
        largest = max(range(len(x)), key=lambda i: abs(x[i]))
        found.append(-x if x[largest] < 0 else x)
    return found


def principal_components(spark: SparkSession, matrix: Matrix, count: int) -> list[Component]:
    """The ``count`` largest positive eigenvalues and their unit eigenvectors; fewer where the rank is lower."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    polynomial = characteristic_polynomial(spark, matrix)
    roots = largest_roots(polynomial, trace, count)
    out: list[Component] = []
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        k = 0
        while k < len(roots):
            same = roots.count(roots[k])
            low, f = roots[k]
            root = (2 * low + 1) * Decimal(2) ** (-f - 1)
            out += [Component(root, tuple(float(c) for c in v)) for v in null_vectors(matrix, root, same)]
            k += same
    return out

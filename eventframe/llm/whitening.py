"""Whitening of embeddings by their principal components, on exact integer statistics.

Entries become whole numbers, so that counts, sums and products over all vectors are exact in any order and however the rows
are partitioned; the components follow from the exact characteristic polynomial of the scatter (:mod:`.spectrum`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spectrum import Component, Matrix, principal_components

SCALE = 256
LIMB = 20           # bits of a factor: products of 2^13 rows add up exactly in double precision
ROWS = 1 << 13
DIGIT = 40          # bits of a partial sum that tasks hand on: 2^23 of them add up in a long


def _entries(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def whole_vectors(embeddings: DataFrame, vector: str, vec_id: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows, x of one length (shorter ones are filled up with zeros), and that length."""
    rows = embeddings.where(usable(vector))
    d = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.concat(_entries(vector, scale), F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(vector)))
    return rows.select(F.col(vec_id).alias("vec_id"), x.alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Factors whose sum, each shifted by LIMB bits more than the one before, is x."""
    if not x.size or np.abs(x).max() < 1 << LIMB and x.min() > -(1 << LIMB):
        return [x.astype(float)]
    parts = [(x >> LIMB * i & (1 << LIMB) - 1).astype(float) for i in range(3)]
    return [*parts, (x >> LIMB * 3).astype(float)]


def _digits(value: int) -> list[int]:
    out = []
    while not -(1 << DIGIT) < value < 1 << DIGIT:
        out.append(value & (1 << DIGIT) - 1)
        value >>= DIGIT
    return [*out, value]


def statistics(fit: DataFrame, d: int) -> tuple[int, list[int], Matrix]:
    """Number of vectors, their sum, and n * sum(x x') - S S' (n^2 times the covariance), all exact."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        total = np.zeros(d, object)
        products = np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            for at in range(0, len(x), ROWS):
                limbs = _limbs(x[at:at + ROWS])
                for i, a in enumerate(limbs):
                    total += a.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
                    for j, b in enumerate(limbs):
                        products += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
        values = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(total)), *((i, j, products[i, j]) for i in range(d) for j in range(i + 1))]
        rows = [(i, j, k, v) for i, j, value in values for k, v in enumerate(_digits(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["i", "j", "digit", "part"])

    added = fit.mapInArrow(sums, "i long, j long, digit long, part long").groupBy("i", "j", "digit").agg(F.sum("part").alias("part"))
    found: dict[tuple[int, int], int] = {}
    for r in added.collect():       # about d * d rows, whatever the number of vectors
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (r["part"] << DIGIT * r["digit"])
    n = found.get((-1, -1), 0)
    total = [found.get((i, -1), 0) for i in range(d)]
    scatter = [[n * found.get((max(i, j), min(i, j)), 0) - total[i] * total[j] for j in range(d)] for i in range(d)]
    return n, total, scatter


def _projected(x: np.ndarray, n: int, total: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and its projections on the axes."""
    large = max([abs(v) for v in total] + [n * int(np.abs(x).max(initial=0))]) >= 1 << 62
    kind = object if large else np.int64
    centred = n * x.astype(kind) - np.array(total, kind)
    return centred, centred.astype(float) @ axes


def whitened(embeddings: DataFrame, components: int = 4, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. The statistics are those of the distinct vectors
    of whole numbers. Vectors shorter than the longest are filled up with zeros. A covariance of lower rank has fewer
    components; equal vectors only, a single one, or an empty table give no rows. Components of equal eigenvalues are some
    orthonormal basis of their space, the same for all rows. Null and repeated ids are kept, every row is judged alone;
    further columns are ignored. The scatter n * sum(x x') - S S' equals the centred products exactly, as all are integers.
    A deviation beyond a long is an error.
    """
    rows, d = whole_vectors(embeddings, vector, vec_id, scale)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, total, scatter = statistics(fit, d)
    found = principal_components(embeddings.sparkSession, scatter, components) if n > 1 else []
    trace = sum(scatter[i][i] for i in range(d))
    explained = [float(c.eigenvalue / trace) for c in found]
    axes = _axes(found, d)
    error = _identity_error(fit, n, total, axes, d) if found else 0.0
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(explained)
        for batch in batches:
            if not m or not batch.num_rows:
                continue
            centred, values = _projected(_matrix(batch.column("x"), d), n, total, axes)
            largest = int(np.abs(centred).max(initial=0))
            exact = centred if largest * largest * d < 1 << 63 else centred.astype(object)
            deviation = pa.array((exact * exact).sum(axis=1).tolist(), pa.int64())
            each = pa.array(np.repeat(np.arange(len(centred)), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(centred))),
                 pa.array(np.full(len(each), n, np.int64)), deviation.take(each), pa.array(values.ravel()),
                 pa.array(np.tile(np.array(explained), len(centred))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _axes(found: list[Component], d: int) -> np.ndarray:
    """Columns that take n * x - S to whitened values."""
    return np.array([[v / float(c.eigenvalue.sqrt()) for v in c.vector] for c in found], float).reshape(len(found), d).T


def _identity_error(fit: DataFrame, n: int, total: list[int], axes: np.ndarray, d: int) -> float:
    """Largest entry, by size, of the covariance of the whitened vectors minus the identity."""
    m = axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = _projected(_matrix(batch.column("x"), d), n, total, axes)
            yield pa.RecordBatch.from_arrays([pa.array(values[:, k]) for k in range(m)], [f"w{k}" for k in range(m)])

    values = fit.mapInArrow(project, ", ".join(f"w{k} double" for k in range(m)))
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    row = values.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

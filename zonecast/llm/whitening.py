"""Embedding whitening, its components found by FEAST contour integration.

The covariance of the quantized vectors is summed in exact integers, so no partitioning changes it. Its leading eigenpairs
come interval by interval: a quadrature of complex shifted solves around an interval projects random vectors on its
eigenspace, Rayleigh-Ritz extracts the pairs, and the inertia of shifted factorizations says how many there must be.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
# Components beyond 2**40 in size are taken as this large, so that sums of products fit 38 digits.
LARGEST = 1 << 50
EXACT = 1 << 53
TOGETHER = 4096
NODES = 8
SEED = 12
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenpairs of a symmetric matrix --------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of a symmetric factorization with complete pivoting."""
    rest = matrix - shift * np.eye(len(matrix))
    growth, positive = (1 + 17**0.5) / 8, 0
    while len(rest):
        diagonal = np.abs(np.diag(rest))
        off = np.abs(rest - np.diag(np.diag(rest)))
        i = int(diagonal.argmax())
        r, c = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[i] == 0 and off[r, c] == 0:
            break
        pivot = [i] if diagonal[i] >= growth * off[r, c] else [int(r), int(c)]
        others = np.setdiff1d(np.arange(len(rest)), pivot)
        block, side = rest[np.ix_(pivot, pivot)], rest[np.ix_(others, pivot)]
        # A two-by-two pivot has a negative determinant, so it holds one eigenvalue of each sign.
        positive += 1 if len(pivot) == 2 else int(block[0, 0] > 0)
        rest = rest[np.ix_(others, others)] - side @ np.linalg.solve(block, side.T)
    return positive


def clear_cut(matrix: np.ndarray, low: float, high: float) -> tuple[float, int]:
    """A place between ``low`` and ``high``, near their middle and away from eigenvalues, and the count above it."""
    middle = 0.5 * (low + high)
    tried = []
    for step in (0, 1, -1, 2, -2, 3, -3):
        at = middle + 0.1 * step * (high - low)
        margin = 0.01 * (high - low)
        above = count_above(matrix, at - margin) - count_above(matrix, at + margin)
        tried.append((above, abs(step), at))
        if not above:
            break
    at = min(tried)[2]
    return at, count_above(matrix, at)


def leading_intervals(matrix: np.ndarray, k: int, most: int = 16) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), highest first, that hold the ``k`` largest eigenvalues, by inertia alone.

    An interval with more than ``most`` eigenvalues, or one reaching over a factor of 4, is cut again, until it is too narrow
    to tell its eigenvalues apart.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor, ceiling, tail = -1e-9 * top, top, len(matrix)
    while tail > max(2 * k, most) and ceiling - floor > 1e-9 * top:
        at, above = clear_cut(matrix, floor, ceiling)
        if above >= k:
            floor, tail = at, above
        else:
            ceiling = at
    out, todo = [], [(floor, top, tail, 0)]
    while todo:
        low, high, n, above = todo.pop()
        if n == 0 or above >= k:
            continue
        wide = n > most or high > 4 * max(low, 1e-6 * top)
        if not wide or n == 1 or high - low < 1e-9 * top:
            out.append((low, high, n))
            continue
        at, over = clear_cut(matrix, low, high)
        over -= above
        todo += [(low, at, n - over, above + over), (at, high, over, above)]
    return out


def eigenpairs_in(matrix: np.ndarray, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenpairs of an interval. More random vectors and nodes are taken until as many as inertia counted are exact."""
    size, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    centre, radius = 0.5 * (low + high), 0.5 * (high - low)
    width, nodes = min(size, n + max(4, n // 2)), NODES
    while True:
        points, weights = np.polynomial.legendre.leggauss(nodes)
        turns = np.exp(1j * 0.5 * np.pi * (1 - points))
        basis = np.random.default_rng((SEED, size, width)).standard_normal((size, width))
        for _ in range(12):
            projected = np.zeros((size, width))
            for turn, weight in zip(turns, weights, strict=True):
                shifted = (centre + radius * turn) * np.eye(size) - matrix
                projected += 0.5 * weight * (radius * turn * np.linalg.solve(shifted, basis.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ turned
            misses = np.linalg.norm(matrix @ basis - basis * values, axis=0)
            inside = np.flatnonzero((values > low) & (values <= high))
            if len(inside) == n and (misses[inside] <= 1e-14 * size**0.5 * scale).all():
                return values[inside], basis[:, inside]
        if width == size:
            # The basis is the whole space: what is left is an eigenvalue at the very edge of the interval.
            near = np.argsort(np.abs(values - centre))[:n]
            return values[near], basis[:, near]
        width, nodes = min(size, 2 * width), 2 * nodes


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns.

    A last Rayleigh-Ritz step over all intervals makes eigenvectors of close eigenvalues on both sides of a cut orthogonal.
    """
    if not len(matrix) or not np.abs(matrix).max() > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    found = [eigenpairs_in(matrix, *interval) for interval in leading_intervals(matrix, min(k, len(matrix)))]
    basis, _ = np.linalg.qr(np.concatenate([vectors for _, vectors in found], axis=1))
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:k]
    order = order[values[order] > 1e-12 * len(matrix) * values.max()]
    return values[order], basis @ turned[:, order]


# --- exact sums ------------------------------------------------------------------------------------


def quantized(cells: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(1024 * c) + 100000 as long."""
    c = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """Sums of products as Python integers; doubles hold those of usual sizes exactly."""
    largest = int(np.abs(rows).max(initial=0))
    if largest * largest * len(rows) < EXACT:
        doubles = rows.astype(np.float64)
        return (doubles.T @ doubles).astype(np.int64).astype(object)
    return rows.T.astype(object) @ rows.astype(object)


@dataclass
class Whitener:
    """What whitens a vector: dimension, rows ``n``, ``base`` + ``rest`` / n the mean, projection, eigenvalues and trace."""

    n: int
    dim: int
    base: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the rounded mean as long, and from the mean as double."""
        y = x - np.array(self.base, dtype=np.int64)
        return y, y - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[1] @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)**2; none where a long can't hold it."""
        y, _ = self.centred(x)
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        whole = np.int64 if largest * largest * self.dim < 1 << 63 else object
        apart = y.astype(whole) * self.n - np.array(self.rest, dtype=whole)
        return [int(s) if s < 1 << 63 else None for s in (apart * apart).sum(axis=1)]


def sound_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id, v`` of rows whose vector is whole and finite."""
    v = F.col(column)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(whole, F.lit(False))).select("vec_id", v.alias("v"))


def batches_of(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and quantized vectors, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            if some.num_rows:
                yield some.column("vec_id"), quantized(some.column("v"), dim)


def summed_products(vectors: DataFrame, dim: int, base: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of the distances from ``base``, per pair of dimensions: one row per pair and task, then a sum."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for _, x in batches_of(dim, batches):
            total = total + exact_gram(x - np.array(base, dtype=np.int64))
        i, j = np.triu_indices(dim)
        some = [Decimal(int(s)) for s in total[i, j]]
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(some, pa.decimal128(38, 0))})

    sums = vectors.mapInArrow(products, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in sums.collect()}


def fit(vectors: DataFrame, dim: int, n: int, sums: list[int], components: int) -> Whitener:
    """Mean, covariance and its leading components. The driver holds the covariance, whose size is the dimension's square."""
    base = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]
    covariance = np.zeros((dim, dim))
    for (i, j), s in summed_products(vectors, dim, base).items():
        covariance[i, j] = covariance[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    values, found = leading_eigenpairs(covariance, components)
    return Whitener(n, dim, base, rest, values, found, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity; the rows are whitened anew for it."""
    k = len(model.values)
    off = np.array([float(Fraction(r, model.n) - Fraction(r / model.n)) for r in model.rest])
    mean = off @ (model.vectors / np.sqrt(model.values))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in batches_of(model.dim, batches):
            apart = model.whitened(x) - mean
            total += apart.T @ apart
        i, j = np.triu_indices(k)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": total[i, j]})

    sums = vectors.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in sums)


def whiten(rows: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every whole and finite vector.

    ``rows`` is read four times, so hand over a written table. Rows with a null vector or a null or non-finite entry go. One covariance
    needs one dimension: where lengths differ, the most frequent one stays (of equally frequent ones the longest). Repeated rows and
    null ids are rows of their own. Entries of 2**40 and more in size count as 2**40. Components whose eigenvalue is
    zero to rounding have no scale and are left out: constant dimensions, fewer rows than components, a single vector. So an
    empty table, or one of equal vectors, gives no rows. ``deviation`` is null where a long can't hold it.
    """
    vectors = sound_vectors(rows, column)
    schema = rows.sparkSession.createDataFrame([], WHITENED).schema
    sized = vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    dims = sized.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    dim, n = dims[0]["dim"], dims[0]["n"]
    vectors = vectors.where(F.size("v") == dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, dtype=object)
        for _, x in batches_of(dim, batches):
            total = total + x.sum(axis=0).astype(object)
        some = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
        yield pa.record_batch({"i": pa.array(range(dim), pa.int32()), "s": some})

    sums = vectors.mapInArrow(totals, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    model = fit(vectors, dim, n, [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])], components)
    k = len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    explained = model.values / model.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in batches_of(dim, batches):
            m = len(x)
            deviation = pa.array(model.deviations(x), pa.int64())
            yield pa.record_batch(
                {
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n, dtype=np.int64),
                    "deviation": deviation.take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": model.whitened(x).reshape(-1),
                    "explained": np.tile(explained, m),
                    "identity_error": np.full(m * k, error),
                }
            )

    return vectors.mapInArrow(apply, schema)

"""Whitening against numpy's eigenvectors, and the contour solver on hard spectra."""

import numpy as np
import pytest

from zonecast.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, label int, v int, component int, n int, dim int, i int, s int"
ODD = [None, [None] + [0.5] * 7, [float("nan")] + [0.5] * 7, [float("inf")] + [0.5] * 7, [0.25, 0.5], []]


@pytest.fixture
def vectors(spark):
    def make(vectors, ids=None):
        return spark.createDataFrame([((ids or range(len(vectors)))[i], v, 1, 2, 3, 4, 5, 6, 7) for i, v in enumerate(vectors)], COLUMNS)

    return make


def turned(values, seed=1):
    """A symmetric matrix of these eigenvalues."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, dtype=float)) @ q.T


SPECTRA = {
    "spread": np.linspace(1, 50, 50),
    "falling fast": 10.0 ** -np.arange(12),
    "one large": [1e9] + [1.0] * 30,
    "all equal": [3.0] * 20,
    "a cluster across the cut": [9.0, 8.0] + [5.0] * 20 + [1.0] * 10,
    "close pairs": np.repeat(np.arange(1.0, 11), 2) + np.tile([0, 1e-9], 10),
    "low rank": [4.0, 2.0] + [0.0] * 18,
    "single": [2.0],
    "two": [2.0, 1.0],
    "noise": np.sort(np.random.default_rng(2).chisquare(200, 100)),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_eigenpairs_equal_numpy(name):
    values = np.sort(np.array(SPECTRA[name], dtype=float))[::-1]
    matrix = turned(values)
    got, vectors = whitening.leading_eigenpairs(matrix, 8)
    want = values[:8][values[:8] > 1e-12 * len(values) * values[0]]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-12, atol=1e-14 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() <= 1e-12 * values[0]


def test_inertia_counts_eigenvalues():
    matrix = turned([-3, -1, 0.5, 2, 2, 7])
    for shift, above in ((-4, 6), (-2, 5), (0, 4), (1, 3), (2.5, 1), (8, 0)):
        assert whitening.count_above(matrix, shift) == above
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((3, 3)), 0.0) == 0


def test_intervals_hold_what_inertia_counts():
    values = np.concatenate([np.linspace(1, 2, 40), [10.0, 11.0, 200.0]])
    intervals = whitening.leading_intervals(turned(values), 8)
    assert sum(n for *_, n in intervals) >= 8
    for low, high, n in intervals:
        assert ((values > low) & (values <= high)).sum() == n


def plain(rows):
    """(vec_id, x) of rows that stay."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in sound], np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in sound], dtype=object)


def test_whitened_rows_equal_numpy(vectors):
    rng = np.random.default_rng(6)
    mixing = rng.standard_normal((8, 8))
    made = [[float(c) for c in row] for row in 0.1 * rng.standard_normal((300, 8)) @ mixing + 0.3]
    rows = list(enumerate(made + ODD + made[:5] + [[0.0] * 8])) + [(None, made[7]), (3, made[9])]
    got = whitening.whiten(vectors([v for _, v in rows], [i for i, _ in rows]), components=6).toPandas()
    ids, x = plain(rows)
    n, total = len(x), x.sum(axis=0)
    centred = (x - total / n).astype(float)
    covariance = centred.T @ centred / n
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1][:6], vectors_[:, ::-1][:, :6]
    want = centred @ vectors_ / np.sqrt(values)
    assert len(got) == 6 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() < 1e-10
    held = got["whitened"].to_numpy().reshape(n, 6)
    own = {}
    for at in range(n):
        own.setdefault(got["vec_id"].iloc[6 * at], []).append((held[at], got["deviation"].iloc[6 * at]))
    sign = np.sign([sum(row[c] * w[c] for (row, _), w in ((own[i][0], want[k]) for k, i in enumerate(ids) if i is not None and len(own[i]) == 1)) for c in range(6)])
    for k, i in enumerate(ids):
        if i is not None:
            deviation = int(((n * x[k] - total) ** 2).sum())
            assert any(np.allclose(row * sign, want[k], atol=1e-9) and d == deviation for row, d in own[i])
    assert np.allclose(got["explained"][:6], values / np.trace(covariance), rtol=1e-10)
    assert list(got["component"][:6]) == [1, 2, 3, 4, 5, 6]


def test_rows_without_a_scale(vectors):
    assert whitening.whiten(vectors([])).collect() == []
    assert whitening.whiten(vectors(ODD[:1])).collect() == []
    assert whitening.whiten(vectors([[0.5] * 4] * 5)).collect() == []
    assert whitening.whiten(vectors([[0.5] * 4])).collect() == []
    two = whitening.whiten(vectors([[0.5, 0.25], [0.125, 0.25], [0.125, 0.25]])).collect()
    assert {r["component"] for r in two} == {1} and len(two) == 3
    assert all(r["explained"] == pytest.approx(1.0) for r in two)
    # The most frequent length stays, the longest of equally frequent ones.
    mixed = whitening.whiten(vectors([[0.5, 0.25], [0.125, 0.5], [0.5, 0.25, 0.75], [0.25, 0.5, 0.125]])).collect()
    assert {r["vec_id"] for r in mixed} == {2, 3}


def test_sums_are_exact_for_large_numbers(vectors):
    rows = np.array([[1 << 40, 3], [5, -(1 << 41)]], dtype=np.int64)
    assert whitening.exact_gram(rows).tolist() == [[(1 << 80) + 25, 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 9 + (1 << 82)]]
    got = whitening.whiten(vectors([[3e38, 0.5], [0.5, 0.5], [-3e38, 0.125]])).collect()
    assert {r["component"] for r in got} <= {1, 2} and all(np.isfinite(r["whitened"]) for r in got)
    assert all(r["deviation"] is None for r in got if r["vec_id"] != 1)


def test_more_partitions_change_nothing(vectors):
    rng = np.random.default_rng(9)
    frame = vectors([[float(c) for c in row] for row in rng.standard_normal((200, 6))])
    one, many = (whitening.whiten(frame.repartition(n)).orderBy("vec_id", "component").toPandas() for n in (1, 7))
    assert one.drop(columns="identity_error").equals(many.drop(columns="identity_error"))

"""Vector operators against plain versions, with odd vectors, repeated rows, and empty tables."""

import collections

import numpy as np
import pytest

from zonecast.llm import projections, retrieval
from zonecast.llm.links import components

COLUMNS = "vec_id long, embedding array<float>, label int, rep long, n int, copies int, v int, dim int, score long"
ODD = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0]]


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, 5, 6) for i, v, label in rows], COLUMNS)

    return make


def clustered(n, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 8))
    out = []
    for i in range(n):
        v = centers[i % 12] + spread * rng.standard_normal(8)
        out.append([float(x) for x in np.float32(v * rng.uniform(0.2, 3))])
    return out


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain_near(rows, cosine):
    near = collections.defaultdict(set)
    for p, (i, v, a) in enumerate(rows):
        for q, (j, w, b) in enumerate(rows[:p]):
            if a is not None and a == b and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out = set()
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.add((i, len(near[i]), min(seen), i == min(seen)))
    return out


@pytest.mark.parametrize("tile", [4096, 40])
def test_near_vectors_equal_brute_force(vectors, monkeypatch, tile):
    monkeypatch.setattr(projections, "TILE", tile)
    made = clustered(240) + [clustered(1)[0]] * 5 + ODD + ODD
    rows = [(1000 - i, v, None if i % 17 == 0 else i % 3 % 2) for i, v in enumerate(made)]
    got = {tuple(r) for r in projections.near_vectors(vectors(rows), 0.93).collect()}
    assert got == plain_near(rows, 0.93)


def test_near_vectors_of_no_rows_and_null_ids(vectors):
    assert projections.near_vectors(vectors([])).count() == 0
    got = projections.near_vectors(vectors([(None, [1.0] * 8, 1), (3, [1.0] * 8, 1), (8, [2.0] * 8, 1)])).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got) == [(-1, 0, None, True), (3, 1, 3, True), (8, 1, 3, False)]


def test_collisions_are_counted_in_centred_windows():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((30, 7)), rng.standard_normal((50, 7))
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.5).sum(axis=2)
    assert (projections.collisions(a, b) == want).all()


def test_only_counted_pairs_are_multiplied(monkeypatch):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 32))
    a[200:] = a[:200] + 0.1 * rng.standard_normal((200, 32))
    seen, plain = [], projections.cosines
    monkeypatch.setattr(projections, "cosines", lambda a, b, i, j, la, lb: seen.append(len(i)) or plain(a, b, i, j, la, lb))
    own = np.sqrt((a * a).sum(axis=1))
    want = (a @ a.T) / (own[:, None] * own[None, :]) >= 0.93
    assert (projections.linked(a, a, 0.93) == want)[~np.eye(400, dtype=bool)].all()
    assert want.sum() <= sum(seen) + 400 < 400 * 400 / 20
    monkeypatch.setattr(projections, "collisions", lambda a, b: np.zeros((len(a), len(b)), np.uint8))
    assert not projections.linked(a, a, 0.93).any()


def test_needed_collisions_keep_recall():
    rng = np.random.default_rng(3)
    lost = pairs = 0
    lines = projections.directions(32)
    for _ in range(300):
        x = rng.standard_normal(32)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(32)
        y -= (y @ x) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y)
        pairs += 1
        lost += projections.collisions((x @ lines)[None], (y @ lines)[None])[0, 0] < projections.needed_collisions(0.93)
    assert lost == 0 and pairs == 300


@pytest.mark.parametrize("bucket", [1024, 16])
def test_top_k_equals_brute_force(vectors, monkeypatch, bucket):
    monkeypatch.setattr(retrieval, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 60)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "SEED_ROWS", 25)
    made = clustered(200, seed=4) + [clustered(1)[0]] * 5 + ODD + [[3.0, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(made)]
    found = retrieval.quantized(vectors(rows + rows[:3]))
    got = {tuple(r) for r in retrieval.top_k(found, found.where("vec_id % 5 = 0"), 7).collect()}
    whole = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i, v in whole.items():
        if i % 5 == 0:
            near = sorted((-int(v @ w), j) for j, w in whole.items() if j != i and len(w) == len(v))[:7]
            want |= {(i, rank, j, -score) for rank, (score, j) in enumerate(near, 1)}
    assert got == want


def test_chunks_too_short_for_a_block_are_not_sent(vectors, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "SEED_ROWS", 60)
    rng = np.random.default_rng(9)
    made = [[float(x) for x in rng.standard_normal(4) * 10 / (1 + i / 20)] for i in range(600)]
    rows = retrieval.quantized(vectors([(i, v, 0) for i, v in enumerate(made)]))
    queries = rows.where("vec_id % 6 = 0")
    asked, held = retrieval.meetings(rows, queries, 5)
    chunks = held.select("_chunk").distinct().count()
    blocks = asked.select("_band", "_block").distinct().count()
    assert chunks < 600 // 40 and asked.count() < 100 * 600 // 40 / 2
    assert held.count() < 600 * blocks / 2
    whole = [np.floor(64 * np.array(v)).astype(int) for v in made]
    got = {tuple(r) for r in retrieval.top_k(rows, queries, 5).collect()}
    want = set()
    for i in range(0, 600, 6):
        near = sorted((-int(whole[i] @ w), j) for j, w in enumerate(whole) if j != i)[:5]
        want |= {(i, rank, j, -score) for rank, (score, j) in enumerate(near, 1)}
    assert got == want


def test_reach_is_the_last_chunk_long_enough():
    longest = np.array([9.0, 0.0, 5.0, 3.0])
    floor, lengths = np.array([90.0, 40.0, 30.0, -(2.0**62), 91.0]), np.array([10.0, 10.0, 10.0, 0.0, 10.0])
    assert retrieval.reach_of(floor, lengths, longest).tolist() == [0, 2, 3, 3, -1]


@pytest.mark.parametrize("dim", [2, 3, 16])
def test_top_k_of_axis_heavy_vectors(monkeypatch, dim):
    monkeypatch.setattr(retrieval, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(dim)
    made = np.floor(rng.standard_normal((600, dim)) * 12)
    made[np.arange(600), rng.integers(0, dim, 600)] += rng.choice([-100.0, 100.0, 0.0], 600)
    made = np.concatenate([made, 100 * np.eye(dim), -100 * np.eye(dim), np.full((1, dim), 31.0)])
    made[-1, 0] = 95.0
    ids = np.arange(len(made))
    order = np.lexsort((ids, -(made * made).sum(axis=1)))
    exact = (made @ made.T).astype(np.int64)
    best = retrieval.Best(ids, 5, np.full(len(ids), -float(1 << 62)))
    retrieval.search(made, best, made[order], ids[order])
    for i in ids:
        near = sorted((-exact[i, j], j) for j in ids if j != i)[:5]
        assert list(zip(best.scores[i], best.found[i], strict=True)) == [(-score, j) for score, j in near]


def test_axis_within_the_threshold_is_a_candidate():
    q, c = np.array([[95.0, 31.0]]), np.array([[100.0, 0.0]])
    best = retrieval.Best(np.array([1]), 1, np.array([0.91 * np.sqrt(95**2 + 31**2) * 100]))
    retrieval.search(q, best, c, np.array([2]))
    assert best.found[0].tolist() == [2]


def test_top_k_of_few_or_no_rows(vectors):
    none = retrieval.quantized(vectors([]))
    assert retrieval.top_k(none, none).count() == 0
    two = retrieval.quantized(vectors([(1, [1.0, 0.5], 0), (2, [-1.0, 0.5], 0), (None, [1.0, 1.0], 0)]))
    assert sorted(tuple(r) for r in retrieval.top_k(two, two).collect()) == [(1, 1, 2, -3072), (2, 1, 1, -3072)]


def test_large_integers_are_exact():
    q, c = np.array([[2.0**31, 1.0]]), np.array([[2.0**30, 7.0], [2.0**30, 8.0]])
    assert retrieval.products(q, c).tolist() == [[2**61 + 7, 2**61 + 8]]


def test_components_of_paths_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(200, i) for i in range(100, 150)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 150)}, 200: 100, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

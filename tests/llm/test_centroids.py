"""Clustering against all distances."""

from hashlib import sha256

import numpy as np
import pytest

from tarnwell.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, ids string"


def brute(rows, k, rounds, dimensions):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = {n: sum(d for _, d, m in last if m == n) for n in range(len(centers))}
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, of[n], sum(of.values()), names[n]) for i, d, n in last), key=str)


def check(spark, rows, k, rounds, dimensions):
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    got = centroids.clusters(df, k, rounds, dimensions)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, rounds, dimensions)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(n, [float(x) for x in rng.normal(size=4)]) for n in range(60)]
    rows += [(100, [0.5] * 4)] * 40  # copies
    rows += [(200 + n, [n % 2 / 4, 0.0, 0.0, 0.0]) for n in range(20)]  # ties
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [float("nan")] * 4), (306, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.25] * 4), (7, [9.0] * 4), (7, [-9.0] * 4), (400, [-0.001] * 4), (401, [1000.0] * 4)]
    check(spark, rows, 7, 4, 4)
    check(spark, rows, 1, 2, 4)


def test_fewer_vectors_than_centroids(spark):
    check(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], 40, 3, 2)


def test_no_vectors(spark):
    check(spark, [], 40, 5, 64)
    check(spark, [(1, [1.0]), (2, None)], 40, 5, 64)


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="no long holds"):
        centroids.clusters(df, dimensions=2).collect()


def test_search_looks_at_few_and_keeps_ties():
    rng = np.random.default_rng(11)
    x = rng.integers(-40, 40, (3000, 6)) + 200 * rng.integers(0, 4, (3000, 1))
    x[:50] = 0
    centers, before, state, looked = x[:30].copy(), None, None, []
    for _ in range(6):
        ball = centroids.Ball.of(centers, before)
        *state, n = centroids.assign(x, ball, state)
        full = ((x[:, None] - centers[None]) ** 2).sum(2)
        assert (state[0] == full.argmin(1)).all()
        looked.append(n)
        rows = [x[state[0] == c] for c in range(len(centers))]
        before, centers = centers, np.array([r.sum(0) // len(r) if len(r) else c for r, c in zip(rows, centers, strict=True)])
    assert looked[0] == 90_000 and max(looked[1:]) < 45_000

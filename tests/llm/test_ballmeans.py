"""Ball k-means against plain rounds in which all vectors meet all centroids."""

import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import ballmeans as B


def plain(rows, k=40, rounds=5, dim=64, scale=256):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) in Python integers."""
    limit, kept = B.most(dim), []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(max(-limit, min(limit, float(np.float32(x)) * scale)))) for x in v]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        best = [min((far(v, y), j) for j, y in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), b in zip(kept, best) if b[1] == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = {}
    for d, j in best:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")
    return B.cluster_report(*B.ball_k_means(df, **kw))


def invented(seed, n, dim, centres, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[i % centres] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("case", [(1, 300, 8, 5, 0.1, 7), (2, 200, 3, 1, 1.0, 12), (3, 60, 64, 9, 0.5, 40)])
def test_rounds_are_exact(spark, case):
    seed, n, dim, centres, spread, k = case
    rows = invented(seed, n, dim, centres, spread)
    got = run(spark, rows, k=k, dim=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, k=k, dim=dim))


def test_ties_repeats_and_rows_that_dont_count(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(2)]) for i in range(80)]
    rows += [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [0.5, 0.5]), (None, [9.0, 9.0]), (100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 0.0]), (105, [float("inf"), 0.0]), (106, [3e38, -3e38]), (107, [-0.001, 0.0])]
    got = run(spark, rows, k=9, dim=2, scale=4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, k=9, dim=2, scale=4), key=str)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    assert sorted(map(tuple, run(spark, rows, dim=2).collect())) == sorted(plain(rows, dim=2))
    got = run(spark, [(1, None), (2, [1.0])], dim=2)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_far_centroids_arent_compared():
    rng = np.random.default_rng(4)
    middle = rng.integers(-(10**5), 10**5, (40, 8))
    x = np.repeat(middle, 50, 0) + rng.integers(-300, 300, (2000, 8))
    balls = B.Balls(middle)
    cluster, distance = balls.assign(x, np.repeat(np.arange(40), 50))
    assert balls.compared == len(x)  # all of them are in stable cores
    wrong = rng.integers(0, 40, len(x))
    moved, far = balls.assign(x, wrong)
    full = B.squared(x, middle)
    assert (moved == full.argmin(1)).all() and (far == full.min(1)).all() and (cluster == moved).all() and (distance == far).all()


@pytest.mark.parametrize("size", [3, 10**4, 1 << 26])
def test_distances_are_exact(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size + 1, (50, 64)), rng.integers(-size, size + 1, (9, 64))
    assert B.squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    assert 4 * 64 * (2 * B.most(64)) ** 2 < 2**63

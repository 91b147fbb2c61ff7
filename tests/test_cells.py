"""The vector index in cells against a full scan."""

import numpy as np
import pytest

from quillspark.operators import ranking
from quillspark.operators.cells import CellIndex


def frame(spark, x, name, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(x.tolist())], f"{name} long, embedding array<double>")


def plain(v, q, k):
    s = np.round(v @ q.T, 6)
    return {(j, int(i), n) for j in range(len(q)) for n, i in enumerate(np.lexsort((np.arange(len(v)), -s[:, j]))[:k]) if s[i, j] > 0}


def ranked(df):
    return {(r.qid, r.vec_id, r.rnk) for r in df.collect()}


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["clustered", "uniform", "of all sizes", "copies"])
def test_results_are_those_of_a_full_scan(spark, kind):
    rng = np.random.default_rng(3)
    middle = unit(rng.normal(size=(20, 8)))
    v = {
        "clustered": lambda: unit(np.repeat(middle, 60, 0) + 0.05 * rng.normal(size=(1200, 8))),
        "uniform": lambda: unit(rng.normal(size=(1200, 8))),
        "of all sizes": lambda: rng.normal(size=(1200, 8)) * rng.exponential(3, (1200, 1)),
        "copies": lambda: np.concatenate([np.repeat(middle[:1], 500, 0), unit(rng.normal(size=(300, 8)))]),
    }[kind]().round(4)
    q = np.concatenate([v[::150], unit(rng.normal(size=(6, 8)))]).round(4)
    index = CellIndex.build(frame(spark, v, "vec_id"), "vec_id", 24)
    assert index.count.sum() == len(v)
    for k in (1, 10, 2000) if kind == "copies" else (10,):
        got, visits = index.top_k(frame(spark, q, "qid"), k)
        assert ranked(got) == plain(v, q, k)
        assert visits.total == len(v) and (visits.vectors <= len(v)).all()
    if kind == "clustered":
        assert visits.share < 0.25


def test_few_probes_find_most(spark):
    rng = np.random.default_rng(5)
    middle = unit(rng.normal(size=(30, 16)))
    v = unit(np.repeat(middle, 40, 0) + 0.1 * rng.normal(size=(1200, 16)))
    q = unit(v[::40] + 0.05 * rng.normal(size=(30, 16)))
    index = CellIndex.build(frame(spark, v, "vec_id"), "vec_id", 30)
    got, visits = index.top_k(frame(spark, q, "qid"), 10, probes=6)
    exact = plain(v, q, 10)
    recall = len({(a, b) for a, b, _ in ranked(got)} & {(a, b) for a, b, _ in exact}) / len(exact)
    assert recall >= 0.9 and visits.cells.max() <= 6 and visits.share < 0.4


def test_only_wanted_cells_are_read(spark):
    v = np.repeat(np.eye(6), 50, 0)
    index = CellIndex.build(frame(spark, v, "vec_id"), "vec_id", 6)
    assert len(index.ids) == 6 and index.radius.max() < 1e-9
    got, visits = index.top_k(frame(spark, np.eye(6)[:2], "qid"), 5)
    assert ranked(got) == plain(v, np.eye(6)[:2], 5) and visits.cells.tolist() == [1, 1] and visits.share == pytest.approx(1 / 6)
    wanted = np.zeros((1, 6), bool)
    wanted[0, 2] = True
    plan = index._scores(np.array([0]), np.eye(6)[:1], wanted, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_no_vectors_and_no_queries(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    index = CellIndex.build(none, "vec_id", 4)
    q = frame(spark, np.eye(3), "qid")
    assert index.top_k(q, 3)[0].count() == 0
    index = CellIndex.build(frame(spark, np.eye(3), "vec_id"), "vec_id", 4)
    assert index.top_k(q.where("false"), 3)[0].count() == 0
    assert ranked(index.top_k(q, 3)[0]) == {(i, i, 0) for i in range(3)}


def test_the_best_of_a_task_with_ties(spark):
    best = ranking.Best(3, most=10)
    rng, seen = np.random.default_rng(1), {}
    for start in range(0, 60, 6):
        keys, s = np.arange(start, start + 6)[::-1], rng.integers(0, 3, (6, 4)).astype(float)
        best.add(np.array([5, 1, 9, 2]), keys, s)
        for j, q in enumerate((5, 1, 9, 2)):
            seen.setdefault(q, []).extend(zip(-s[:, j], keys.tolist()))
    (batch,) = best.batches("key")
    assert sorted(zip(*(c.to_pylist() for c in batch.columns))) == sorted((q, k, -s) for q, x in seen.items() for s, k in sorted(x)[:3])

"""Commits and the shared log under races and failures."""

import threading

import pytest

from quillspark.scratch import scratch_path
from quillspark.sources.commits import Commits, SharedLog


def test_a_number_is_taken_once(spark):
    commits = Commits(spark, scratch_path(spark, "c"))
    assert commits.latest() == (0, None) and commits.all() == []
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((i, commits.take(1, {"who": i})))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [i for i, ok in won if ok]
    assert commits.latest() == (1, {"who": winner})
    assert commits.take(2, {"who": "ä"}) and [b["who"] for b in commits.all()] == [winner, "ä"]


def rows(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b string, c string")


def log(spark, root):
    return SharedLog(spark, root, "a long, b string, c string", ["a", "b"])


def test_two_writers_and_one_that_dies(spark):
    root = scratch_path(spark, "log")
    one, two = log(spark, root), log(spark, root)
    assert one.append(rows(spark, [(1, "x"), (1, "x"), (2, "y")])) == 1

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        two.append(rows(spark, [(8, "lost")]), before_commit=die)
    assert one.read().count() == 2

    # While the first is between writing and committing, the second commits the same pairs and another.
    def overtake(done=[]):
        if not done:
            done.append(True)
            assert two.append(rows(spark, [(3, "z"), (4, "z")])) == 2

    assert one.append(rows(spark, [(3, "z"), (2, "y"), (5, "v")]), before_commit=overtake) == 3
    got = sorted((r.a, r.b) for r in two.read().collect())
    assert got == [(1, "x"), (2, "y"), (3, "z"), (4, "z"), (5, "v")]


def test_writers_at_the_same_time(spark):
    root, failed = scratch_path(spark, "log"), []

    def write(n):
        try:
            for i in range(3):
                log(spark, root).append(rows(spark, [(j, str(j % 2)) for j in range(i + n, i + n + 6)]))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in (0, 2, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(r.a for r in log(spark, root).read().collect()) == list(range(12))


def test_a_batch_is_appended_once(spark):
    one = log(spark, scratch_path(spark, "log"))
    assert one.append(rows(spark, [(1, "x")]), "b-1") == 1
    assert one.append(rows(spark, [(9, "other")]), "b-1") is None
    handle = one.sink("s")
    for _ in range(2):
        handle(rows(spark, [(2, "x")]), 0)
    handle(rows(spark, [(3, "x")]), 1)
    assert sorted(r.a for r in one.read().collect()) == [1, 2, 3]

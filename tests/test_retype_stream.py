"""Re-typing as a stream against the same log in one batch."""

import random

import pytest

from quillspark.operators import graph
from quillspark.streaming import retype

KINDS = ["none", "interpreted_by", "clarified_by", "overrides", "references", "cites"]


def flat(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,n_files", [(1, 1), (2, 4)])
def test_any_split_of_the_log(spark, tmp_path, seed, n_files):
    rng = random.Random(seed)
    pairs = [(f"a{i}", f"b{j}") for i in range(4) for j in range(3)]
    edges = spark.createDataFrame([(a, b, "cites", 0.85, "k" if n % 2 else None, n) for n, (a, b) in enumerate(pairs)], "from string, to string, relation string, confidence double, ref_key string, adj_ord long")
    lines = [(n, *rng.choice([*pairs[:-2], ("lost", "x")]), rng.choice(KINDS), rng.choice([0.3, 0.69, 0.7, 0.9, 0.5])) for n in range(70)]
    log = spark.createDataFrame(lines, retype.LOG)
    rng.shuffle(lines)  # late and out of order, some of them twice
    source = tmp_path / "log"
    for i in range(n_files):
        part = lines[i::n_files] + lines[: 5 if i else 0]
        spark.createDataFrame(part, retype.LOG).coalesce(1).write.json(str(source / f"part={i}"))
    stream = spark.readStream.schema(retype.LOG).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").json(str(source))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        retype.run_to_end(retype.changed_edges(stream, edges), target, checkpoint).awaitTermination()
    words = retype.last_words(spark, target)
    want, stats = graph.retype(edges, log)
    columns = ["from", "to", "relation", "confidence", "ref_key", "llm_typed", "adj_ord"]
    assert flat(retype.settled(edges, words).select(columns)) == flat(want.select(columns))
    assert flat(retype.counters(words)) == flat(stats)


def test_no_row_goes_through_python(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "cites", 0.85)], "from string, to string, relation string, confidence double")
    (tmp_path / "log").mkdir()
    stream = spark.readStream.schema(retype.LOG).json(str(tmp_path / "log"))
    plan = retype.changed_edges(stream, edges)._jdf.queryExecution().logical().toString()
    assert "Python" not in plan and "Pandas" not in plan

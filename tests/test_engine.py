"""The engine end to end on a few chunks."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.operators import graph, ranking
from quillspark.sources import models
from test_operators import CHUNK, chunk


def test_engine(spark):
    texts = {"a": "apples and pears", "b": "pears and plums", "c": "roads and rails", "d": "rails across town"}
    c = spark.createDataFrame([chunk(i, title=i, text=t, chunk_ord=n) for n, (i, t) in enumerate(texts.items())], CHUNK).selectExpr("*", "0 as chunk_index")
    vectors = models.embed_chunks(c.selectExpr("chunk_ord", "'' as title", "text"), models.hashed_embedder(32), "chunk_ord")
    parents = spark.createDataFrame([(i, "ARTICLE", None) for i in texts], "id string, type string, date string")
    edges = spark.createDataFrame([("c", "d", "cites", 0)], "from string, to string, relation string, adj_ord long")
    plan = lambda q: json.dumps(["pears", "plums"]) if "fruit" in q else "no plan"
    engine = Engine(c, vectors, parents, edges, models.hashed_embedder(32), plan, pool=2)
    questions = spark.createDataFrame([(1, "which fruit"), (2, "roads")], "qid long, question string")
    subs = sorted((r.qid, r.sub_idx, r.text) for r in engine.sub_queries(questions).collect())
    assert subs == [(1, 0, "pears"), (1, 1, "plums"), (2, 0, "roads")]
    with pytest.raises(Exception, match="too large"):
        engine.sub_queries(spark.createDataFrame([(1 << 43, "roads")], "qid long, question string")).collect()
    packed = {r.qid: r.context for r in engine.answer_context(questions, k=2).collect()}
    assert "pears and plums" in packed[1] and "roads and rails" in packed[2]
    events = sorted((r.qid, r.seq, r.event, r.data) for r in engine.ask_events(questions, k=4).collect())
    mine = [e for e in events if e[0] == 2]
    assert [e[2] for e in mine][:2] == ["plan", "sub_done"] and mine[-1][2] == "done"
    assert any(json.loads(e[3]) == {"from": "c", "to": "d", "relation": "cites"} for e in mine if e[2] == "hop")


def test_whole_event_stream(spark):
    """More hops and sources than a screen shows, a long context, sub-queries and questions without hits."""
    n = 40
    about = lambda i: f"{'pears' if i < 30 else 'roads'} number{i} " + "word " * 120
    c = spark.createDataFrame([chunk(f"n{i:02d}", title=f"n{i}", text=about(i), chunk_ord=i) for i in range(n)], CHUNK).selectExpr("*", "0 as chunk_index")
    vectors = spark.createDataFrame([], "chunk_ord long, embedding array<float>")
    parents = spark.createDataFrame([(f"n{i:02d}", "ARTICLE", None) for i in range(n)], "id string, type string, date string")
    edges = spark.createDataFrame([("n00", f"n{i:02d}", "cites", i) for i in range(1, n)], "from string, to string, relation string, adj_ord long")
    plan = lambda q: json.dumps(["number0", "number0", "nowhere"]) if q == "first" else "[]"
    engine = Engine(c, vectors, parents, edges, models.hashed_embedder(32), plan)
    questions = spark.createDataFrame([(1, "first"), (2, "nothing like it")], "qid long, question string")
    events = {q: [] for q in (1, 2)}
    for r in engine.ask_events(questions, k=35).orderBy("qid", "seq").collect():
        events[r.qid].append((r.event, json.loads(r.data)))
    of = lambda name, q=1: [d for e, d in events[q] if e == name]
    assert [d["to"] for d in of("hop")] == 2 * [f"n{i:02d}" for i in range(1, n)]
    assert len(of("sources")) == 35 and of("done")[0]["n_blocks"] == 70 and of("done")[0]["n_chars"] > 70 * 600
    assert [(d["sub_idx"], d["hits"], d["new_parents"]) for d in of("sub_done")] == [(0, 35, 35), (1, 35, 0), (2, 0, 0)]
    assert [(d["id"], d["sub_idx"]) for d in of("entry")] == [(f"n{i:02d}", 0 if i < 35 else None) for i in range(n)]
    assert [(e, d.get("hits"), d.get("n_blocks")) for e, d in events[2]] == [("plan", None, None), ("sub_done", 0, None), ("done", None, 0)]
    few = engine.ask_events(questions, k=35, budget=1500, most_hops=30, most_sources=25)
    assert {r.event: r.n for r in few.where("qid = 1").groupBy("event").agg(F.count("*").alias("n")).collect()} == {"plan": 1, "sub_done": 3, "entry": 35, "hop": 30, "sources": 25, "done": 1}


def test_what_a_walk_found_is_ranked_without_texts(spark):
    """Of all chunks of the visited parents only ids go through the windows; texts are joined to the k that are left."""
    c = spark.createDataFrame([chunk(f"p{i}#c{j}", parent_id=f"p{i}", text=f"t{i}{j}", chunk_ord=i * 10 + j) for i in range(4) for j in range(3)], CHUNK)
    ordered = spark.createDataFrame([(1, f"p{i}", 3 - i) for i in range(4)], "qid long, id string, parent_ord long")
    matched = spark.createDataFrame([(1, "p3#c2", 1)], "qid long, id string, rank long")
    out = graph.reexpand(ordered, c, matched, 2)
    assert [(r.rank, r.id, r.parent_id, r.text) for r in out.orderBy("rank").collect()] == [(1, "p3#c2", "p3", "t32"), (2, "p3#c0", "p3", "t30")]
    plan = out._jdf.queryExecution().optimizedPlan()
    windows = [n for n in [plan.apply(i) for i in range(60)] if n is not None and n.nodeName() == "Window"]
    assert windows and not any("text#" in w.output().mkString(",") for w in windows)


def test_embedder_hashes_a_word_once(monkeypatch):
    calls = []
    plain = models.hashlib.blake2b
    monkeypatch.setattr(models.hashlib, "blake2b", lambda w, **k: calls.append(w) or plain(w, **k))
    embed = models.hashed_embedder(8)
    got = embed(["a b A a", "", "b c"] * 20)
    assert sorted(calls) == [b"a", b"b", b"c"] and (got[:3] == got[57:]).all() and abs(got[0]).sum() in (2, 4) and not got[1].any()


def test_engine_upkeep(spark):
    """Warm-up, cancellation, the registry, search fallback and counters."""
    import threading
    import time

    from quillspark.operators import stats

    c = spark.createDataFrame([chunk("a", title="a", text="apples", chunk_ord=0)], CHUNK).selectExpr("*", "0 as chunk_index")
    made = models.embedder("hashed-16")
    vectors = models.embed_chunks(c.selectExpr("chunk_ord", "title", "text"), made.make(), "chunk_ord")
    edges = spark.createDataFrame([], "from string, to string, relation string, adj_ord long")
    engine = Engine(c, vectors, spark.createDataFrame([("a", "ARTICLE", None)], "id string, type string, date string"), edges, made.make())
    row = engine.warm_up(made.dim).first()
    assert (row.n, row.bad_dim, row.not_unit) == (1, 0, 0) and engine.index.docs == 1

    with pytest.raises(KeyError):
        models.embedder("none of this name")
    assert models.embedder().dim == 16

    stopper = threading.Thread(target=lambda: (time.sleep(2), engine.cancel("listener-gone")))
    stopper.start()
    started = time.time()
    with pytest.raises(Exception, match="(?i)cancel"), engine.cancellable("listener-gone"):
        spark.range(0, 10**12, 1, 8).selectExpr("sum(hash(id))").collect()
    stopper.join()
    assert time.time() - started < 60 and spark.range(3).count() == 3

    def search(question):
        if "fail" in question:
            raise OSError("no network")
        return f"found {question}"

    questions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "fail")], "qid long, question string")
    got = {r.qid: (r.context, r.searched) for r in models.search_fallback(questions, spark.createDataFrame([(1, "here")], "qid long, context string"), search).collect()}
    assert got == {1: ("here", False), 2: ("found y", True), 3: ("search failed: no network", True)}

    counted, seen = stats.observed(spark.range(50).toDF("id"), "written")
    counted.write.format("noop").mode("overwrite").save()
    assert stats.throughput(seen, 2.0) == {"rows": 50, "seconds": 2.0, "rows_per_second": 25.0}


def test_many_query_vectors(spark):
    """More query vectors than one broadcast block."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 4)).round(3)
    q = rng.normal(size=(5000, 4)).round(3)
    frame = lambda x, name: spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], f"{name} long, embedding array<double>")
    got = ranking.top_k(ranking.vector_scores(frame(v, "vec_id"), frame(q, "qid"), "vec_id", 3), "vec_id", 3).collect()
    s = np.round(v @ q.T, 6)
    want = {(j, int(i), n) for j in range(5000) for n, i in enumerate(np.lexsort((np.arange(300), -s[:, j]))[:3]) if s[i, j] > 0}
    assert {(r.qid, r.vec_id, r.rnk) for r in got} == want

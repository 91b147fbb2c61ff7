"""Operators on hand-made rows and against plain procedural models."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, corpus, graph, ranking, retrieval, serving, stats
from quillspark.profile import DEFAULT
from quillspark.sources.commits import SharedLog
from quillspark.sources import io, models
from quillspark.streaming import resume


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fusion(spark):
    lists = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "b", 0), (0, "c", 1)], "qid long, id string, rnk int")
    got = {r.id: r.rrf for r in ranking.fuse(lists, "id").collect()}
    assert got == {"a": 1 / 60, "b": pytest.approx(1 / 61 + 1 / 60), "c": 1 / 61}


CHUNK = "id string, parent_id string, source string, type string, statute string, title string, text string, date string, superseded_by string, references array<string>, chunk_ord long"


def chunk(i, parent=None, source="finlex", refs=(), **more):
    row = {"id": i, "parent_id": parent or i.split("#")[0], "source": source, "type": "ARTICLE", "statute": "A", "title": "t", "text": "x", "date": None, "superseded_by": None, "references": list(refs), "chunk_ord": 0}
    return tuple((row | more).values())


def test_boost_counts_once(spark):
    c = spark.createDataFrame([chunk("Tuloverosopimukset_x", source="vero")], CHUNK)
    v = spark.createDataFrame([(0, "Tuloverosopimukset_x", 0)], "qid long, id string, rnk int")
    assert retrieval.fused_hits(v, v.where("false"), c).first().score == pytest.approx(1.15 / 60)


def expand_model(hits, refs, index, ids):
    """The walk that ``expand`` states as sets."""
    out = {}
    for nid, score in hits:
        out[nid] = max(out.get(nid, 0), score)
        for ref in refs.get(nid, [])[:3]:
            for target in index.get(ref, [])[:2]:
                if target not in out:
                    out[target] = score * 0.6
        if "Tuloverosopimukset" in nid and "#chunk" in nid:
            base, at = nid.rsplit("#chunk", 1)
            for off in range(-3, 4):
                other = f"{base}#chunk{int(at) + off}"
                if off and other in ids and other not in out:
                    out[other] = score * 0.75
    return out


def test_expansion_against_the_walk(spark):
    rng = random.Random(5)
    all_hits, all_chunks, all_sections, want = [], [], [], {}
    for q in range(25):
        ids = [f"q{q}_{'Tuloverosopimukset_' if i % 3 == 0 else ''}{i // 4}#chunk{i % 4}" for i in range(12)]
        keys = [f"q{q}_K{i}" for i in range(4)]
        refs = {i: rng.sample(keys, rng.randint(0, 4)) for i in ids}
        index = {k: rng.sample(ids, rng.randint(0, 4)) for k in keys}
        hits = [(i, rng.choice([0.1, 0.2, 0.3, 0.5])) for i in rng.sample(ids, 6)]
        want |= {(q, k): v for k, v in expand_model(hits, refs, index, set(ids)).items()}
        all_hits += [(q, i, s, n) for n, (i, s) in enumerate(hits)]
        all_chunks += [chunk(i, refs=refs[i]) for i in ids]
        all_sections += [(k, n, i) for k, v in index.items() for n, i in enumerate(v)]
    h = spark.createDataFrame(all_hits, "qid long, id string, score double, fuse_ord long")
    got = retrieval.expand(h, spark.createDataFrame(all_chunks, CHUNK), spark.createDataFrame(all_sections, "ref_key string, pos long, chunk_id string"))
    assert {(r.qid, r.id): r.score for r in got.collect()} == pytest.approx(want)


def test_cap(spark):
    data = [(0, f"p#chunk{i}", "p", i) for i in range(5)] + [(0, "q", "q", 9)] + [(1, f"Tuloverosopimukset#chunk{i}", "T", i) for i in range(5)]
    df = spark.createDataFrame(data, "qid long, id string, parent_id string, rnk int")
    got = ranking.parent_cap(df, [F.col("rnk")], ranking.cap_of(F.col("id")), 10)
    assert rows(got, "qid", "rank", "rnk") == [(0, 1, 0), (0, 2, 1), (0, 3, 9), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_parents(spark):
    c = spark.createDataFrame([chunk("a#chunk0", date=None, refs=["r1", "r2"], chunk_ord=0), chunk("a#chunk1", date="2021-01-01", refs=["r2", "r3"], chunk_ord=1), chunk("a#chunk2", date="2022-01-01", chunk_ord=2)], CHUNK)
    p = corpus.collapse_parents(c).first()
    assert (p.date, p.chunk_ids, p.references) == ("2021-01-01", ["a#chunk0", "a#chunk1", "a#chunk2"], ["r1", "r2", "r3"])


PARENT = "id string, source string, type string, statute string, title string, date string, references array<string>, parent_ord long"


def test_citation_cap_skips_unfit_targets(spark):
    data = [("p1", "finlex", "ARTICLE", "A", "t", None, ["k"], 1), ("p2", "vero", "GUIDANCE", "A", "t", None, ["k"], 2)] + [(f"p{i}", "finlex", "ARTICLE", "A", "t", None, ["k"], i) for i in range(3, 8)]
    p = spark.createDataFrame(data, PARENT)
    got = graph.build_edges(p, corpus.parent_sections(p)).where("from = 'p1'")
    assert rows(got, "to", "relation") == [("p3", "cites"), ("p4", "cites"), ("p5", "cites")]


def test_amendments(spark):
    data = [("law", "finlex", "STATUTE", "A", "Laki", None, ["A_§69"], 0), ("change", "finlex", "STATUTE", "A", "Laki A 69 ja 71 §:n muuttamisesta", None, [], 1), ("other", "finlex", "STATUTE", "A", "69 §:n Muuttamisesta", None, [], 2)]
    p = spark.createDataFrame(data, PARENT)
    got = graph.build_edges(p, corpus.parent_sections(p))
    assert rows(got.where("relation = 'amends'"), "from", "to", "ref_key") == [("change", "law", "A_§69"), ("other", "law", "A_§69")]


EDGE = "edge_ord struct<phase:int,p:long,i:int,n:int>, from string, to string, relation string, confidence double, ref_key string"


def test_last_attributes_first_place(spark):
    e = spark.createDataFrame([((0, 1, 0, 1), "u", "v", "cites", 0.85, "k1"), ((1, 1, 0, 1), "u", "v", "amends", 0.75, "k2")], EDGE)
    r = graph.assemble(e).first()
    assert (r.relation, r.ref_key, tuple(r.adj_ord)) == ("amends", "k2", (0, 1, 0, 1))


def retype_model(edges, log):
    g, stats_ = {k: [v[0], v[1], False] for k, v in edges.items()}, dict.fromkeys(("dropped_none", "retyped", "kept_references", "low_conf_skipped", "missing_edge"), 0)
    for f, t, rel, conf in log:
        if (f, t) not in g:
            stats_["missing_edge"] += 1
        elif conf < 0.7:
            stats_["low_conf_skipped"] += 1
        elif rel == "none":
            del g[f, t]
            stats_["dropped_none"] += 1
        elif rel in ("interpreted_by", "clarified_by", "overrides"):
            g[f, t] = [rel, conf, True]
            stats_["retyped"] += 1
        elif rel == "references":
            g[f, t][1:] = [min(g[f, t][1], 0.6), True]
            stats_["kept_references"] += 1
    return g, stats_


def test_retyping_against_the_loop(spark):
    rng = random.Random(3)
    edges = {(f"u{i}", f"v{i % 7}"): ("cites", 0.85) for i in range(40)}
    keys = [*edges, ("x", "y")]
    log = [(*rng.choice(keys), rng.choice(["none", "interpreted_by", "clarified_by", "overrides", "references", "odd"]), rng.choice([0.5, 0.7, 0.9])) for _ in range(200)]
    e = spark.createDataFrame([(f, t, r, c, "k", i) for i, ((f, t), (r, c)) in enumerate(edges.items())], "from string, to string, relation string, confidence double, ref_key string, adj_ord long")
    got, counters = graph.retype(e, spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "line long, from string, to string, relation string, confidence double"))
    want, told = retype_model(edges, log)
    assert {(r["from"], r["to"]): [r.relation, r.confidence, r.llm_typed] for r in got.collect()} == want
    assert counters.first().asDict() == told


def walk_model(entry, out, back, hops, cap):
    visited, frontier, log = set(entry), list(entry), []
    for _ in range(hops):
        new = []
        for pid in frontier:
            for t, rel in out.get(pid, []):
                if rel in DEFAULT.hop_relations and t not in visited:
                    visited.add(t)
                    new.append(t)
                    log.append((pid, t, rel))
            for s, rel in back.get(pid, []):
                if rel == "amends" and s not in visited:
                    visited.add(s)
                    new.append(s)
                    log.append((s, pid, "amends (newer)"))
            if len(new) >= cap:
                break
        frontier = new[:cap]
    return visited, log


def test_walk_against_the_loop(spark):
    from dataclasses import replace

    rng = random.Random(11)
    profile = replace(DEFAULT, frontier_cap=3)
    edges, entries, want = [], [], []
    for q in range(12):
        nodes = [f"{q}_{i}" for i in range(14)]
        pairs = rng.sample([(a, b) for a in nodes for b in nodes if a != b], 45)
        typed = [(a, b, rng.choice(["cites", "amends", "clarified_by", "overrides"])) for a, b in pairs]
        out, back = {}, {}
        for a, b, r in typed:
            out.setdefault(a, []).append((b, r))
            back.setdefault(b, []).append((a, r))
        entry = rng.sample(nodes, 3)
        want.append(walk_model(entry, out, back, 2, 3))
        edges += [(a, b, r, len(edges) + i) for i, (a, b, r) in enumerate(typed)]
        entries += [(q, e, i) for i, e in enumerate(entry)]
    visited, log = graph.walk(spark.createDataFrame(entries, "qid long, id string, f_ord long"), spark.createDataFrame(edges, "from string, to string, relation string, adj_ord long"), 2, profile)
    seen, told = {}, {}
    for r in visited.collect():
        seen.setdefault(r.qid, set()).add(r.id)
    for r in sorted(log.collect(), key=lambda r: (r.hop, r.ord)):
        told.setdefault(r.qid, []).append((r["from"], r["to"], r.relation))
    for q, (v, steps) in enumerate(want):
        assert seen[q] == v and told.get(q, []) == steps


def test_packing_stops(spark):
    b = spark.createDataFrame([(0, 1, "x" * 5), (0, 2, "x" * 6), (0, 3, "x")], "qid long, rank int, block string")
    assert rows(context.pack_blocks(b, 10), "rank") == [(1,)]


def test_excerpt(spark):
    c = spark.createDataFrame([chunk(f"a#chunk{i}", text="x" * n, chunk_ord=i) for i, n in enumerate((2000, 900, 50))], CHUNK)
    assert context.excerpts(c).first().excerpt == "x" * 2000 + "\n" + "x" * 500


def test_evaluation(spark):
    results = spark.createDataFrame([("basic", 0.125), ("medium", 0.375), ("hard", 0.55), ("other", 1.0)], "tier string, fact_score double")
    assert rows(stats.eval_buckets(results), "bucket", "pct", "color") == [("basic", 12, "red"), ("hard", 55, "green"), ("medium", 38, "amber")]
    answers = spark.createDataFrame([("q", "basic", "§ 1")], "id string, tier string, answer string")
    judged = spark.createDataFrame([], "id string, covered boolean")
    r = stats.score_answers(judged, answers).first()
    assert (r.fact_score, r.has_citation, r.facts_total, r.passed) == (0.0, True, 0, False)


def test_limit_keeps_whole_documents(spark):
    d = spark.createDataFrame([(i, 3) for i in range(5)], "doc_ord long, chunk_total int")
    assert rows(corpus.limit_documents(d, 4), "doc_ord") == [(0,), (1,)]


def test_vector_ranking_of_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>")
    got = ranking.top_k(ranking.vector_scores(v, q, "vec_id", 10), "vec_id", 10)
    assert rows(got, "rnk", "vec_id") == [(0, 1), (1, 2)]


def test_events(spark):
    a = spark.createDataFrame([(0, 0, None)], "qid long, ord long, text string")
    r = serving.event_rows([("plan", a)]).first()
    assert r.frame == 'event: plan\ndata: {"text":null}\n\n'


def test_sources(spark, tmp_path):
    (tmp_path / "kb/vero/x").mkdir(parents=True)
    (tmp_path / "kb/finlex").mkdir()
    (tmp_path / "kb/vero/x/b.html").write_bytes(b"<h1>TVL</h1><p>palkka \xff</p>")
    (tmp_path / "kb/finlex/a.html").write_text("<p>nothing here</p>")
    raw = io.scan_html(spark, str(tmp_path / "kb"))
    assert rows(io.number_documents(raw, "vero"), "doc_ord", "path") == [(0, "vero/x/b.html"), (1, "finlex/a.html")]
    c = corpus.parse_corpus(spark, raw).collect()
    assert [(r.id, r.source, r.statute, r.text) for r in c] == [("vero_x_b", "vero", "TVL", "palkka �")]
    (tmp_path / "log.jsonl").write_text('{"from": "a", "to": "b", "relation": "none", "confidence": 0.9}\nnot json\n')
    assert io.read_json_lines(spark, str(tmp_path / "log.jsonl")).count() == 1
    assert io.read_or_empty(spark, str(tmp_path / "none"), io.EDGE).count() == 0


def test_build_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    v, path = spark.range(5), str(tmp_path / "index")
    held = io.build_once(spark, path, v, build)
    for source in (v, spark.range(6)):
        assert io.build_once(spark, path, source, build).count() == 3
    assert len(calls) == 2 and held.count() == 3  # readers of the version before keep it


def test_build_once_tells_repeats_and_nulls_apart(spark, tmp_path):
    built = []
    sources = ([("a", "b")], [("a", "b")] * 3, [("a", None)], [(None, "a")], [("c", "d")] * 2 + [("a", "b")], [("a", "b")] * 3 + [("c", "d")] * 2)
    for rows_ in sources:
        io.build_once(spark, str(tmp_path / "index"), spark.createDataFrame(rows_, "x string, y string"), lambda: built.append(1) or spark.range(1))
    assert len(built) == len(sources)


def test_streaming_resume(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, name in ((1, "a"), (2, "b")):
        (folder / f"{name}.json").write_text("".join(f'{{"from": "f{i}", "to": "t", "relation": "cites", "confidence": 0.9}}\n' for i in range(n + 1)))
        resume.process_new(resume.stream_log(spark, str(folder)), resume.append_distinct(target, ["from", "to"]), str(tmp_path / "cp")).awaitTermination()
    assert rows(SharedLog(spark, target, io.EXTRACTION, ["from", "to"]).read(), "from") == [("f0",), ("f1",), ("f2",)]


def test_plug_points(spark):
    q = spark.createDataFrame([(0, "one two"), (1, "three")], "qid long, question string")
    replies = spark.createDataFrame([(0, '["one", "two"]'), (1, "oops")], "qid long, reply string")
    assert rows(models.sub_queries(q, replies), "qid", "sub_idx", "text") == [(0, 0, "one"), (0, 1, "two"), (1, 0, "three")]
    c = spark.createDataFrame([("a", "t", "body words"), ("b", None, None)], "id string, title string, text string")
    got = {r.id: r.embedding for r in models.embed_chunks(c, models.hashed_embedder(8)).collect()}
    assert sum(x * x for x in got["a"]) == pytest.approx(1) and set(got["b"]) == {0.0}


@pytest.mark.parametrize("most", [400_000, 0])
def test_walk_through_nodes_of_high_degree(spark, most):
    """Frontiers of hubs that share their neighbours: several rounds, the same walk as the loop's, and little reached that isn't kept."""
    from dataclasses import replace

    rng = random.Random(5)
    profile = replace(DEFAULT, frontier_cap=4)
    hubs, pairs = [f"h{i}" for i in range(12)], []
    for i in range(400):
        to = rng.sample(hubs, 1 if i < 200 else 2) if i % 4 else hubs[:6]
        pairs += [(f"n{i}", h, rng.choice(["cites", "amends", "amends"])) for h in to]
    pairs += [(a, b, "cites") for a in hubs for b in rng.sample(hubs, 3) if a != b]
    out, back = {}, {}
    for a, b, r in pairs:
        out.setdefault(a, []).append((b, r))
        back.setdefault(b, []).append((a, r))
    entry = {q: rng.sample(hubs, 2) + rng.sample([f"n{i}" for i in range(400)], 5) if q % 2 else [f"n{i}" for i in rng.sample(range(400), 6)] for q in range(16)}
    entries = [(q, e, i) for q, es in entry.items() for i, e in enumerate(es)]
    edges = [(a, b, r, i) for i, (a, b, r) in enumerate(pairs)]
    visited, log = graph.walk(spark.createDataFrame(entries, "qid long, id string, f_ord long"), spark.createDataFrame(edges, "from string, to string, relation string, adj_ord long"), 2, profile, most=most)
    seen, told = {}, {}
    for r in visited.collect():
        seen.setdefault(r.qid, []).append(r.id)
    for r in sorted(log.collect(), key=lambda r: (r.hop, r.ord)):
        told.setdefault(r.qid, []).append((r["from"], r["to"], r.relation))
    for q, es in entry.items():
        v, steps = walk_model(es, out, back, 2, 4)
        assert sorted(seen[q]) == sorted(v) and told.get(q, []) == steps


def test_a_hop_stops_at_the_first_hub(spark, monkeypatch):
    """Of a frontier of 10 hubs with 500 sources each only the first is gone through, and no table of visited nodes is broadcast."""
    edges = [(f"n{h}_{i}", f"h{h}", "amends", h * 1000 + i) for h in range(10) for i in range(500)]
    entries = spark.createDataFrame([(q, f"h{(q + h) % 10}", h) for q in range(3) for h in range(10)], "qid long, id string, f_ord long")
    plans, real = [], graph.materialize

    def kept(df, tag):
        plans.append((tag, df))
        return real(df, tag)

    monkeypatch.setattr(graph, "materialize", kept)
    visited, _ = graph.walk(entries, spark.createDataFrame(edges, "from string, to string, relation string, adj_ord long"), 1)
    assert visited.count() == 3 * 510
    hop = [df for tag, df in plans if tag == "hop"]
    assert len(hop) == 1 and hop[0].count() == 3 * 500
    plan = hop[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "sum(degree" in plan

"""What a step costs as its input grows: texts cut once, shares of tasks that stay bounded."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus, graph, inverted, ranking
from quillspark.profile import DEFAULT


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "x " * 900), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    cut = corpus.exploded(docs, T.chunk_text(F.col("text"), DEFAULT), "piece")
    assert plan(cut).count("split(") == 1
    got = {(r.doc_id, r.chunk_index, r.chunk_total, None if r.piece is None else len(r.piece)) for r in cut.collect()}
    assert got == {(1, 0, 3, 800), (1, 1, 3, 800), (1, 2, 3, 499), (2, 0, 1, 5), (3, 0, 1, None), (4, 0, 1, 0)}


def test_windows_without_enough_text_go(spark):
    pad = lambda n: "a" + " " * 700 + " " * 2000 + "b" * n + " " * 600
    docs = spark.createDataFrame([(n, pad(n)) for n in (118, 119, 120, 121)], "n long, text string")
    left = docs.select("n", F.explode(T.chunk_text(F.col("text"))).alias("w")).select("n", F.length(T.strip(F.col("w"))))
    assert sorted(map(tuple, left.collect())) == [(118, 1), (119, 1), (120, 120), (121, 121)]  # a text without windows keeps its start


def test_shares_of_tasks_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "ROWS", 20)
    index = inverted.LexicalIndex.open(spark, str(tmp_path / "i"), parts=1, bits=0)
    docs = spark.range(100).select(F.col("id").alias("key"), F.lit(4).cast("long").alias("dl"), F.array(*map(F.lit, "abca")).alias("tokens"))
    blocks = index._blocks(docs, 400)
    sizes = [sum(r.n for r in x) for x in blocks.rdd.glom().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 20


def test_unique_keys_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "b a b a b"), (2, ""), (3, None), (4, "c")], "key long, text string")
    posts = ranking.unique_postings(docs, "key", "text")
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, posts.collect())) == sorted(map(tuple, ranking.postings(docs, "key", "text").collect())) == [(1, "a", 2), (1, "b", 3), (4, "c", 1)]


def test_places_of_a_key_are_not_ordered_together(spark):
    """One key that every parent bears: the targets are those of a loop, and no plan sorts or numbers the places of a key."""
    kinds = [("finlex", "t"), ("vero", "t"), ("finlex", "Laki A 3 ja 4 §:n muuttamisesta")]
    data = [(f"p{i}", kinds[i % 3][0], "ARTICLE", "A", kinds[i % 3][1], None, ["A_§3", f"A_§{100 + i % 40}"] if i % 5 else ["A_§3"], i) for i in range(300)]
    p = spark.createDataFrame(data, "id string, source string, type string, statute string, title string, date string, references array<string>, parent_ord long")
    got = graph.build_edges(p)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    keys = {d[0]: {*d[6], *(["A_§3", "A_§4"] if "ja" in d[4] else [])} for d in data}
    want = set()
    for d in data:
        for refs, relation, fits in ((d[6], "cites", lambda t: t[1] == "finlex"), (["A_§3", "A_§4"] if "ja" in d[4] else [], "amends", lambda t: t[1] == "finlex" and "ja" not in t[4])):
            for k in refs:
                want |= {(d[0], t[0], relation, k) for t in [t for t in data if k in keys[t[0]] and fits(t) and t[0] != d[0]][:3]}
    assert {(r["from"], r["to"], r.relation, r.ref_key) for r in got.collect()} == want
    shuffled = graph.build_edges(p, corpus.parent_sections(p), most=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))


def test_documents_of_a_level_are_written_once(spark, tmp_path, monkeypatch):
    tags, real = [], inverted.materialize
    monkeypatch.setattr(inverted, "materialize", lambda df, tag: tags.append(tag) or real(df, tag))
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "key long, text string")
    index = inverted.LexicalIndex.open(spark, str(tmp_path / "i"), parts=2, bits=1).refresh(docs, "key", "text")
    assert tags == ["changes"] and index.length == 4
    assert sorted((r.key, r.dl, r.tokens) for r in index.live_docs().collect()) == [(1, 3, ["a", "b", "a"]), (2, 1, ["c"]), (3, 0, [])]

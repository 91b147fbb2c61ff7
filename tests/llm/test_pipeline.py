"""The pipeline as a whole against a plain version of its stages."""

import random

import pytest
from test_brute import ALNUM, LOWER, groups_model, invented, mix_model

import corpus_pipeline
from quillspark.llm import secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, tk long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(50)
    rows, labels = [], []
    for i in range(400):
        w = invented(rng, rng.randint(20, 80), 3000).split()
        toxic = i % 5 == 0
        for _ in range(5 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["foulword", "nastyterm", "vileness"])
        rows.append((i, " ".join(w), rng.choice("ab")))
        labels.append((i, 1, int(toxic)))
    items = [(i, invented(rng, 14, 4000)) for i in range(5)]
    for i in range(400, 440):
        w = rows[i - 399][1].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "b"))
    rows += [(440 + i, invented(rng, 30, 3000) + " " + items[i][1].upper() + " " + invented(rng, 9, 3000), "a") for i in range(5)]
    rows += [(450 + i, f"{invented(rng, 30, 3000)} password = Zk3vQ9xT1mB7pL{i} {invented(rng, 5)} q8Zt4XvB1nM7kP2wR9sY6cJd", "c") for i in range(6)]
    rows += [(460, None, "a"), (461, "", None), (462, " ", "c"), (None, invented(rng, 40, 3000), "a"), (3, rows[3][1], rows[3][2]), (464, rows[7][1], None)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(d, t, "en", s, None if t is None else len(t), "x", 1) for d, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def plain(rows):
    return sorted(((r[0], r[1], r[2]) for r in rows), key=str)


def test_pipeline(spark, tables):
    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    have = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    # 1: the model's own scores, held against the labels in the tests of the operator
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.predicted}
    truly = {d for d, t, _ in have if t and {"foulword", "nastyterm", "vileness"} & set(t.split())}
    assert len(bad & truly) > 0.95 * len(truly) and len(bad - truly) < 5
    have = [r for r in have if r[0] not in bad]
    staged = corpus_pipeline.drop_toxic(spark, docs, path)
    assert plain(staged.select("doc_id", "text", "source").collect()) == plain(have) and staged.columns == docs.columns
    # 2: one row of each group
    stays, seen = [], set()
    least = {(d, n): c for d, n, c, _ in groups_model([r[:2] for r in have], 5, 80)}
    for r in sorted(have, key=lambda r: (r[0] is None, r[0] or 0)):
        n = next(n for d, n in least if d == r[0])
        group = (least[r[0], n], n > 0 and r[0] is not None)
        if n == 0 or r[0] is None or group not in seen and least[r[0], n] == r[0]:
            stays.append(r)
            seen.add(group)
    # 3: no window of an item
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [ALNUM.findall(t.translate(LOWER))] for i in range(len(w) - 9)}
    clean = []
    for r in stays:
        w = ALNUM.findall((r[1] or "").translate(LOWER))
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            clean.append(r)
    assert len(clean) == len(stays) - 5
    # 4: no secrets, by a model of the same documents
    left = spark.createDataFrame(clean, "doc_id long, text string, source string")
    pair = secrets.train(left)
    redacted = [(d, t if t is None else secrets.redact_text(t, secrets.find_spans(t, pair, 16, 10.0)), s) for d, t, s in clean]
    assert sum("[secret]" in (t or "") for _, t, _ in redacted) >= 6 and not any("Zk3vQ9" in (t or "") for _, t, _ in redacted)
    # 5: what the mix takes
    size, total, target = mix_model([(d, t, s) for d, t, s in redacted])
    out = corpus_pipeline.run(spark, path).collect()
    texts = {(d, t, s): n for (d, t, s), n in zip(redacted, size)}
    assert all(texts[r.doc_id, r.text, r.source] == r.size and r.copies in (1, 2) for r in out) and len({(r.doc_id, r.text) for r in out}) == len(out)
    for s in total:
        taken = sum(r.taken for r in out if r.source == s)
        assert abs(taken - target[s]) <= max((n for n, (*_, x) in zip(size, redacted) if x == s), default=0) / 2 + 1
    assert all(r.n_chars == len(r.text) and r.tk == 1 for r in out if r.text is not None)


def test_empty_tables(spark, tables, tmp_path):
    path, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

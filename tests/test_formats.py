"""The formats against the plain readers, with filters, cuts anywhere, and appended lines."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import formats, io


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture()
def tree(tmp_path):
    for path, raw in {"finlex/b/x.html": b"<p>b", "finlex/a.html": b"<p>\xff\xc3", "vero/y.html": "<p>ä".encode(), "vero/z/deep/q.html": b" ", "vero/other.txt": b"no", "vero/_hidden.html": b"h"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    return str(tmp_path)


def test_html_trees(spark, tree):
    plain = io.number_documents(io.scan_html(spark, tree).where("not contains(path, '_hidden')"), "vero")
    for size in (5, 1 << 20):
        df = spark.read.format("html_tree").option("first", "vero").option("bytes", size).load(tree)
        assert rows(df, "path", "raw", "doc_ord") == rows(plain, "path", "raw", "doc_ord")
    assert df.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("condition,paths", [("path = 'vero/y.html'", ["vero/y.html"]), ("path like 'finlex/%'", ["finlex/a.html", "finlex/b/x.html"]), ("path in ('vero/y.html', 'none')", ["vero/y.html"]), ("startswith(path, 'vero') and raw <> ' '", ["vero/y.html"])])
def test_filters_reach_the_listing(spark, tree, condition, paths):
    df = spark.read.format("html_tree").option("first", "vero").load(tree)
    assert [r[0] for r in rows(df.where(condition), "path")] == paths
    numbers = dict(rows(df, "path", "doc_ord"))
    assert dict(rows(df.where(condition), "path", "doc_ord")) == {p: numbers[p] for p in paths}


def test_only_listed_files_are_opened(tree):
    reader = formats.HtmlTreeReader({"path": tree})
    left = list(reader.pushFilters([formats.StringStartsWith(("path",), "vero/"), formats.EqualTo(("raw",), "x")]))
    assert left == [formats.EqualTo(("raw",), "x")]
    assert [f for p in reader.partitions() for f, _ in p.files] == ["vero/y.html", "vero/z/deep/q.html"]


LINES = [json.dumps({"from": f"a{i}", "to": "ä" * (i % 7), "relation": "cites", "confidence": i / 10 if i % 3 else 1, "more": [1]}, ensure_ascii=False) for i in range(40)]


def test_json_lines_cut_anywhere(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join([*LINES[:25], "not json", "[1]", "", '{"from": 7, "confidence": true}']) + "\n")
    (tmp_path / "two.json").write_text("\r\n".join(LINES[25:]))  # no end of line at the end
    good = io.read_json_lines(spark, str(tmp_path)).where("relation is not null")
    for size in (61, 333, 1 << 20):
        df = spark.read.format("json_log").option("bytes", size).load(str(tmp_path))
        assert rows(df.where("relation is not null").drop("bad")) == rows(good)
        assert rows(df.where("bad is not null"), "bad") == [("[1]",), ("not json",)]
        assert df.count() == 40 + 3
    narrow = spark.read.format("json_log").schema("from string, confidence double").load(str(tmp_path))
    assert narrow.count() == 41 and narrow.where("from is null and confidence is null").count() == 1
    with pytest.raises(Exception, match="no columns of the type"):
        spark.read.format("json_log").schema("a array<int>").load(str(tmp_path)).collect()


def test_appended_lines_are_new_rows(spark, tmp_path):
    folder, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def run():
        s = spark.readStream.format("json_log").option("bytes", 50).load(str(folder))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(once=True).start().awaitTermination()
        return sorted(r["from"] for r in spark.read.parquet(out).where(F.col("from").isNotNull()).collect())

    log = folder / "a.jsonl"
    log.write_text("\n".join(LINES[:5]) + "\n" + LINES[5][:10])  # the last line is being written
    assert run() == sorted(f"a{i}" for i in range(5))
    with log.open("a") as f:
        f.write(LINES[5][10:] + "\n" + LINES[6] + "\n")
    (folder / "b.jsonl").write_text(LINES[7] + "\nbroken\n")
    assert run() == sorted(f"a{i}" for i in range(8))
    assert run() == sorted(f"a{i}" for i in range(8))
    assert spark.read.parquet(out).where("bad = 'broken'").count() == 1

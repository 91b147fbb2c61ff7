"""Scalar functions on small cases."""

from pyspark.sql import functions as F

from quillspark.functions import html
from quillspark.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_chunk_short(spark):
    assert one(spark, T.chunk_text(F.col("t")), t="a" * 800) == ["a" * 800]


def test_chunk_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1500))
    assert one(spark, T.chunk_text(F.col("t")), t=text) == [text[:800], text[650:1450], text[1300:]]


def test_chunk_short_tail_is_dropped(spark):
    assert [len(c) for c in one(spark, T.chunk_text(F.col("t")), t="x" * 1400)] == [800, 750]


def test_chunk_headings(spark):
    got = one(spark, T.chunk_text(F.col("t")), t="intro " * 100 + "\n2.7 Xyz part" + " more" * 60)
    assert len(got) == 2 and got[1].startswith("2.7 Xyz")


def test_chunk_of_blanks_keeps_its_start(spark):
    assert one(spark, T.chunk_text(F.col("t")), t=" " * 900) == [" " * 800]


def test_references(spark):
    ref = T.extract_references(F.col("t"), F.col("s"))
    assert one(spark, ref, t="5 § ja § 7, 5 §", s="AAA") == ["AAA_§5", "AAA_§7"]
    assert one(spark, ref, t="12a § and 12 a §", s="AAA") == ["AAA_§12a"]
    assert one(spark, ref, t="5 §", s=None) == []


def test_title_pairs(spark):
    from quillspark.operators.corpus import title_sections

    assert set(one(spark, title_sections(F.col("t"), F.lit("A")), t="69 ja 71 §")) == {"A_§69", "A_§71"}


def test_dates(spark):
    for text, want in (("on 2024/3/5 x", "2024-03-05"), ("1.1.2024", None), ("2024-00-10", "2024-00-10")):
        assert one(spark, T.extract_date(F.col("t")), t=text) == want


def test_statutes_and_types(spark):
    assert one(spark, T.infer_statute(F.col("t"), F.lit("p")), t="Laki arvonlisäverolain muuttamisesta") == "AVL"
    assert one(spark, T.infer_statute(F.col("t"), F.lit("p")), t="nothing") is None
    assert one(spark, T.classify_type(F.lit("finlex"), F.col("t")), t="Asetukset") == "ARTICLE"
    assert one(spark, T.classify_type(F.lit("finlex"), F.col("t")), t="asetus 3") == "STATUTE"
    assert one(spark, T.classify_type(F.lit("vero"), F.col("t")), t="KVL") == "COURT_CASE"


def test_ids(spark):
    assert one(spark, T.node_id(F.col("t")), t="vero/a b/c.html") == "vero_a_b_c"
    assert one(spark, T.parent_of(F.col("t")), t="a#chunk1#chunk22") == "a#chunk1"


def test_expand_query(spark):
    got = one(spark, T.expand_query(F.col("t")), t="TVL xTVLx MYEL")
    assert got == "Tuloverolaki (TVL) xTVLx Maatalousyrittäjien eläkelaki (MYEL)"


def test_fences(spark):
    f = T.FENCE
    for text, want in ((f'{f}json\n["a"]\n{f}', ["a"]), ('["b"]', ["b"]), ("junk", None), (f'{f}\n["c"]', ["c"])):
        assert one(spark, T.parse_reply(F.col("t"), "array<string>"), t=text) == want


def test_markers(spark):
    assert one(spark, T.is_refusal(F.col("t")), t="I Cannot Find it") is True
    assert one(spark, T.is_refusal(F.col("t")), t=None) is False
    assert one(spark, T.has_citation(F.col("t")), t="katso Ohje") is True
    assert one(spark, T.has_citation(F.col("t")), t="12 §") is False


def test_keywords(spark):
    assert one(spark, T.keyword_match(F.col("p"), F.col("t")), p="vero/x", t="") is True
    assert one(spark, T.keyword_match(F.col("p"), F.col("t")), p="x", t="ELÄKE") is True
    assert one(spark, T.keyword_match(F.col("p"), F.col("t")), p="x", t="a" * 2000 + "palkka") is False


def test_html_leaves():
    long = "word " * 50
    title, text = html.read_page(f"<html><body><h1>Head</h1><div><p>{long}</p></div><script>no()</script><p>tail</body></html>")
    assert title == "Head" and text == f"{long.strip()} tail"
    title, text = html.read_page("<html><title>T</title><body><h2>Sub</h2>loose</body></html>", "stem")
    assert title == "T" and text == "Sub loose"
    assert html.read_page(None, "stem") == ("stem", "")


def test_references_without_semicolon():
    page = "<h1>R&amp;D &lt;&amp;&amp &ltx &#65; &#65 A&B</h1>"
    assert html.read_page(page, closed=True)[0] == "R&D <&&amp &ltx A &#65 A&B"
    assert html.read_page(page)[0] == "R&D <&& <x A A A&B"

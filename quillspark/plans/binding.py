"""The driver's tables in the roles of chunks, parents, queries and logs.

The tables hold no statutes, sections or dates, so those are derived from
``doc_id`` by fixed rules, the same here and in the SQL of ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.functions import text as T
from quillspark.operators import corpus, graph, ranking, retrieval
from quillspark.operators.cells import CellIndex
from quillspark.operators.inverted import LexicalIndex
from quillspark.profile import DEFAULT
from quillspark.scratch import materialize, scratch_path
from quillspark.sources import models

LICENSES = replace(DEFAULT, keywords="licen[cs]e|copyright|GNU")


_built: dict[tuple[str, str, str, str], DataFrame] = {}


def version(spark: SparkSession, sf: str) -> str:
    """Size and time of the tables that indexes are built from."""
    told = []
    for name in ("documents", "benchmark", "embeddings"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        told.append(f"{store.getFileStatus(path).getModificationTime()}:{store.getContentSummary(path).getLength()}")
    return ",".join(told)


def once(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Builds an index table on first use in a session and keeps it in the shared folder; changed tables are indexed anew."""

    @wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, version(spark, sf), build.__name__)
        if key not in _built:
            _built[key] = materialize(build(spark, sf), build.__name__)
        return _built[key]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    text = lambda n: n.cast("string")
    statute = F.concat(F.lit("L"), text(i % 6))
    amending = F.concat(F.lit("Laki "), statute, F.lit(" "), text(i % 23), F.lit(" ja "), text(i % 29), F.lit(" §:n muuttamisesta"))
    source = F.when(F.col("source").isin("src0", "src1", "src2"), "vero").otherwise("finlex")
    kind = F.when(i % 7 == 0, "COURT_CASE").when(source == "vero", "GUIDANCE").when((i % 7).isin(1, 2), "STATUTE").otherwise("ARTICLE")
    date = F.when(i % 3 != 0, F.concat(F.lit("20"), F.lpad(text(i % 20), 2, "0"), F.lit("-"), F.lpad(text(i % 12 + 1), 2, "0"), F.lit("-01")))
    return d.select(
        "doc_id", "text", "lang", source.alias("source"), statute.alias("statute"), F.when(i % 5 == 0, amending).otherwise(F.concat(F.lit("Ohje "), text(i), F.lit(" - "), F.col("lang"))).alias("title"),
        kind.alias("type"), date.alias("date"), F.concat(F.when(i % 10 == 3, "Tuloverosopimukset_").otherwise("d_"), text(i)).alias("parent_id"),
    )


@once
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    rows = corpus.exploded(d, T.chunk_text(F.col("text"), DEFAULT), "piece")
    i, c = F.col("doc_id"), F.col("chunk_index")
    marks = F.concat(F.col("piece"), F.lit(" "), ((i * 13 + c * 5) % 31).cast("string"), F.lit(" § "), ((i * 7 + c) % 31).cast("string"), F.lit(" §"))
    return rows.select(
        T.chunk_id(F.col("parent_id"), c, F.col("chunk_total")).alias("id"), "parent_id", "chunk_index", "chunk_total", "source", "type", "statute", "title", F.col("piece").alias("text"), "date",
        F.lit(None).cast("string").alias("superseded_by"), T.extract_references(marks, F.col("statute")).alias("references"), F.lit(None).cast("string").alias("file_path"), (i * 1000 + c).alias("chunk_ord"), "doc_id",
    )


@once
def parents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.collapse_parents(chunks(spark, sf))


@once
def edges_raw(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(parents(spark, sf))


@once
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.assemble(edges_raw(spark, sf))


@once
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(edges(spark, sf))


def walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.walk(walk_entries(spark, sf), edges(spark, sf), steps=adjacency(spark, sf))


def _number(c: str):
    return F.regexp_extract(c, r"_(\d+)$", 1).cast("long")


def extraction_log(e: DataFrame) -> DataFrame:
    """Two lines for each edge and one for an edge that isn't there."""
    f, t = _number("from"), _number("to")
    names = F.array(*[F.lit(x) for x in ("none", "interpreted_by", "clarified_by", "overrides", "references", "cites")])
    pick = lambda n: F.get(names, (n % 6).cast("int"))
    one = e.select((f * 100000 + t).alias("line"), "from", "to", pick(f * 7 + t * 3).alias("relation"), ((f + t * 5) % 10 / 10).alias("confidence"))
    two = e.select((f * 100000 + t + 10**12).alias("line"), "from", "to", pick(f * 3 + t * 11).alias("relation"), ((f * 2 + t) % 10 / 10).alias("confidence"))
    lost = e.where(f % 50 == 0).select((f * 100000 + t + 2 * 10**12).alias("line"), "from", F.lit("nowhere_1").alias("to"), F.lit("cites").alias("relation"), F.lit(0.9).alias("confidence"))
    return one.unionByName(two).unionByName(lost)


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All tokens of each benchmark item."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(T.tokens(F.col("text"))).alias("token"))


def chunk_postings(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.unique_postings(bodies(spark, sf), "chunk_ord", "body")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_ord", F.concat("title", F.lit(" "), "text").alias("body"))


_indexes: dict[tuple[str, str, str], LexicalIndex] = {}


def lexical_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The lexical index of all chunks, built on first use; ranges of the chunks of about 130 documents."""
    key = (spark.sparkContext.applicationId, sf, version(spark, sf))
    if key not in _indexes:
        _indexes[key] = LexicalIndex.open(spark, scratch_path(spark, "lexical"), parts=16, bits=17).refresh(bodies(spark, sf), "chunk_ord", "body")
    return _indexes[key]


def lexical_list(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    return lexical_index(spark, sf).top_k(query_tokens(spark, sf), k, key="chunk_ord")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding").join(items, "qid", "left_semi")


_cells: dict[tuple[str, str, str], CellIndex] = {}


def vector_cells(spark: SparkSession, sf: str) -> CellIndex:
    """All vectors in 16 cells, stored on first use."""
    key = (spark.sparkContext.applicationId, sf, version(spark, sf))
    if key not in _cells:
        _cells[key] = CellIndex.build(table(spark, sf, "embeddings"), "vec_id", 16)
    return _cells[key]


def vector_list(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    scores = ranking.vector_scores(table(spark, sf, "embeddings"), query_vectors(spark, sf), "vec_id", k)
    return ranking.top_k(scores, "vec_id", k)


def ranked_lists(spark: SparkSession, sf: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Both lists over chunk ids; a vector stands for the first chunk of its document."""
    c = chunks(spark, sf)
    lex = materialize(lexical_list(spark, sf, k), "ranked").join(c.select("chunk_ord", "id"), "chunk_ord").select("qid", "id", "rnk")
    vec = vector_list(spark, sf, k).join(c.where("chunk_index = 0").select(F.col("doc_id").alias("vec_id"), "id"), "vec_id").select("qid", "id", "rnk")
    return vec, lex


@once
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_sections(chunks(spark, sf))


def hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Hybrid retrieval for every benchmark item."""
    vec, lex = ranked_lists(spark, sf)
    return retrieval.retrieve(vec, lex, chunks(spark, sf), sections(spark, sf), k)


@once
def wide_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of a walk: ``entry_multiple`` times as many hits as asked for."""
    return hits(spark, sf, 10 * DEFAULT.entry_multiple).select("qid", "id", "parent_id", "rank")


def walk_entries(spark: SparkSession, sf: str) -> DataFrame:
    return wide_hits(spark, sf).groupBy("qid", F.col("parent_id").alias("id")).agg(F.min("rank").alias("f_ord"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@once
def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).select("chunk_ord", "title", "text")
    return models.embed_chunks(c, models.embedder("hashed-16").make(), "chunk_ord")


def engine(spark: SparkSession, sf: str) -> Engine:
    """The engine over the bound tables, with stand-in models."""
    return Engine(chunks(spark, sf), chunk_vectors(spark, sf), parents(spark, sf), edges(spark, sf), models.embedder("hashed-16").make(), models.halving, index=lexical_index(spark, sf))

"""From raw pages or texts to the table of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import html
from quillspark.functions import text as T
from quillspark.profile import DEFAULT, Profile

CHUNK_COLUMNS = ["id", "parent_id", "chunk_index", "chunk_total", "source", "type", "statute", "title", "text", "date", "superseded_by", "references", "file_path"]


def keyword_filter(raw: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Rows (path, raw) with a keyword in the path or at the start of the raw text."""
    return raw.where(T.keyword_match(F.col("path"), F.col("raw"), profile))


def describe_documents(docs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Metadata of documents (path, title, text): source, folder, id, type, statute, date.

    Blank texts are dropped; ``doc_ord`` orders the authority source first, then paths.
    """
    parts = F.split("path", "/")
    out = docs.where(F.length(T.strip(F.col("text"))) > 0)
    out = out.withColumn("source", F.get(parts, F.lit(0))).withColumn("folder", F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(""))
    out = out.withColumn("parent_id", T.node_id(F.col("path"))).withColumn("type", T.classify_type(F.col("source"), F.col("folder"), profile))
    return out.withColumn("statute", T.infer_statute(F.col("title"), F.col("path"), profile)).withColumn("date", T.extract_date(F.col("text"), profile))


def exploded(docs: DataFrame, pieces: Column, name: str) -> DataFrame:
    """``docs`` with chunk_total, chunk_index and the piece for each of ``pieces``, which are cut once a row.

    The inner explode lets Spark infer filters on its input, each of which would cut the text anew.
    """
    rows = docs.withColumn("__pieces", pieces).select("*", F.size("__pieces").alias("chunk_total"), F.posexplode_outer("__pieces").alias("chunk_index", name))
    return rows.where(F.col("chunk_index").isNotNull()).drop("__pieces")


def explode_chunks(docs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The chunk table of described documents, one row for each chunk."""
    rows = exploded(docs, T.chunk_text(F.col("text"), profile), "chunk")
    rows = rows.withColumn("text", F.col("chunk")).withColumn("id", T.chunk_id(F.col("parent_id"), F.col("chunk_index"), F.col("chunk_total")))
    rows = rows.withColumn("references", T.extract_references(F.col("text"), F.col("statute"), profile)).withColumn("superseded_by", F.lit(None).cast("string"))
    return rows.withColumn("file_path", F.col("path")).select(*CHUNK_COLUMNS)


def parse_corpus(spark: SparkSession, raw: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Raw HTML rows (path, raw) to chunks: the cheap keyword test runs before the HTML parser."""
    kept = keyword_filter(raw, profile).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    parsed = html.page_texts(kept, "path", "raw", "stem")
    return explode_chunks(describe_documents(parsed, profile), profile)


def limit_documents(docs: DataFrame, n: int, size: str = "chunk_total", order: str = "doc_ord") -> DataFrame:
    """The first documents until ``n`` chunks are reached; the last one stays whole.

    The running sum goes over two levels, so that the order is never one task's:
    ranges of 65,536 documents are summed first.
    """
    block = docs.withColumn("__b", F.floor(F.col(order) / 65536))
    sums = block.groupBy("__b").agg(F.sum(size).alias("__s"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.coalesce(F.sum(size).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return block.join(sums, "__b").withColumn("__before", F.col("__before") + inside).where(F.col("__before") < n).drop("__b", "__before")


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Ids that more than one chunk bears (long paths are cut)."""
    return chunks.groupBy("id").count().where("count > 1")


def collapse_parents(chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """One row for each parent: first values, first date that is not empty, chunk ids and distinct references in order."""
    rows = chunks.withColumn("pid", F.coalesce("parent_id", T.parent_of(F.col("id"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() | F.lit(True), F.col(order))).alias(c)
    dated = F.min_by("date", F.when(F.coalesce(F.col("date"), F.lit("")) != "", F.col(order))).alias("date")
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda x: x["id"]).alias("chunk_ids")
    refs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("references").alias("r")))), lambda x: F.coalesce(x["r"], F.array().cast("array<string>"))))).alias("references")
    return rows.groupBy(F.col("pid").alias("id")).agg(first("source"), first("type"), first("statute"), first("title"), dated, ids, refs, F.min(order).alias("parent_ord"))


def chunk_sections(chunks: DataFrame, profile: Profile = DEFAULT, order: str = "chunk_ord") -> DataFrame:
    """Section index of chunks (ref_key, pos, chunk_id), from the title and the start of the text."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, profile.section_prefix))
    keys = chunks.where("statute is not null and statute != ''").select("id", order, F.explode(F.array_distinct(T.extract_references(text, F.col("statute"), profile))).alias("ref_key"))
    keys = keys.groupBy("ref_key", "id").agg(F.min(order).alias(order))
    return keys.select("ref_key", (F.row_number().over(W.partitionBy("ref_key").orderBy(order)).cast("long") - 1).alias("pos"), F.col("id").alias("chunk_id"))


def title_sections(title, statute, profile: Profile = DEFAULT):
    """Distinct section keys of a title, pairs included."""
    numbers = F.array_distinct(F.concat(T.section_numbers(title, profile), T.pair_numbers(title, profile)))
    return F.transform(numbers, lambda n: F.concat(statute, F.lit("_§"), n))


def section_places(parents: DataFrame, profile: Profile = DEFAULT, *more: str) -> DataFrame:
    """(ref_key, parent_ord, id, and columns ``more``): where each section key is, by the references and the sections of the titles of parents."""
    none = F.array().cast("array<string>")
    keys = F.concat(F.coalesce("references", none), F.coalesce(F.when(F.coalesce("statute", F.lit("")) != "", title_sections(F.coalesce("title", F.lit("")), F.col("statute"), profile)), none))
    return parents.select("id", "parent_ord", *more, F.explode(F.array_distinct(keys)).alias("ref_key"))


def parent_sections(parents: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Section index of parents (ref_key, pos, parent_id): their references and the sections of their titles."""
    rows = section_places(parents, profile)
    return rows.select("ref_key", (F.row_number().over(W.partitionBy("ref_key").orderBy("parent_ord")).cast("long") - 1).alias("pos"), F.col("id").alias("parent_id"))

"""Packing evidence into bounded contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.profile import DEFAULT, Profile

SEPARATOR = "\n\n---\n\n"


def pack_blocks(blocks: DataFrame, budget: int | None) -> DataFrame:
    """The blocks (qid, rank, block) of each query before the first that exceeds the budget; without one, all."""
    if budget is None:
        return blocks
    total = F.sum(F.length("block")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("total", total).where(F.col("total") <= budget)


def pack_context(hits: DataFrame, budget: int | None = 8000) -> DataFrame:
    """(qid, n_blocks, context): the hits of each query as one text of at most ``budget`` characters, if told, and separators."""
    columns = {c: F.col(c) for c in ("id", "title", "source", "type", "date", "text")}
    kept = pack_blocks(hits.select("qid", "rank", T.context_block(columns).alias("block")), budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return kept.groupBy("qid").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(parts, SEPARATOR).alias("context"))


def excerpts(chunks: DataFrame, profile: Profile = DEFAULT, order: str = "chunk_ord") -> DataFrame:
    """(id, title, excerpt): the first characters of each parent's chunks, the last one cut, joined by line breaks."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("parent_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", before).where(F.col("before") < profile.excerpt_chars)
    rows = rows.withColumn("part", F.expr(f"substring(text, 1, cast({profile.excerpt_chars} - before as int))"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "part"))), lambda x: x["part"])
    title = F.coalesce(F.min_by("title", F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col(order))), F.col("parent_id"))
    return rows.groupBy("parent_id").agg(title.alias("title"), F.array_join(parts, "\n").alias("excerpt")).withColumnRenamed("parent_id", "id")

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.ballmeans import BALLS_SQL, ball_k_means, cluster_report
from quillspark.llm.bytebpe import read_ranks, token_digests, vocabulary
from quillspark.llm.decontaminate import WINNOW_SQL, decontaminate
from quillspark.llm.htmltext import render_pages
from quillspark.llm.mixing import MIX_SQL, pareto_mix
from quillspark.llm.neardup import near_duplicates
from quillspark.llm.periodic import periodic_runs, run_report, with_loops
from quillspark.llm.quality import quality_rules
from quillspark.llm.secrets import scan_secrets
from quillspark.llm.substrings import remove_repeats
from quillspark.llm.toxicity import score_toxicity, train
from quillspark.llm.units import UNITS_SQL, document_repeats
from quillspark.llm.warc import WARC_SQL, page_records
from quillspark.shipping import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 400 that occur twice in all documents, removed."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and n-gram ratio of every whole document, the good labels as target."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose sets of word pairs are alike to 80 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items, windows of ten words."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back in chunks."""
    return page_records(spark, table(spark, sf_dir, "pages"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 5, 2, 1, half again as many words, no more than two copies."""
    return pareto_mix(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines and sentences of every document, with the occurrences that are kept."""
    return document_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by models of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, laid out."""
    return render_pages(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and character models over every whole document."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and more in every whole document, a tenth of which are looped."""
    return run_report(periodic_runs(with_loops(table(spark, sf_dir, "documents"))))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds."""
    return cluster_report(*ball_k_means(table(spark, sf_dir, "embeddings")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Every whole document encoded by a public vocabulary and decoded again."""
    return token_digests(table(spark, sf_dir, "documents"), vocabulary(read_ranks(ranks), public_tokenizers.PATTERN))


def shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: list[Query] = [op1_warc_chunks, op2_pareto_mix, op3_suffix_levels, op4_quality_llr, op5_setsketch_dedup, op6_decontaminate, op7_line_dedup, op8_toxicity, op9_html_layout, op10_secret_scan, op11_periodic_runs, op12_ball_kmeans, op13_byte_bpe]


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_chunks": WARC_SQL, "op2_pareto_mix": MIX_SQL, "op6_decontaminate": WINNOW_SQL, "op7_line_dedup": UNITS_SQL, "op12_ball_kmeans": BALLS_SQL}

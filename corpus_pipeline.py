"""From the documents table to a clean, weighted training mix, in five stages.

Each stage is a function of (spark, docs, sf_dir).  It works on everything its
predecessor kept and returns the columns of documents; the last one adds what
the mix takes of each document.  ``run`` writes each stage's rows as Parquet to
the shared folder and starts the next one from the files.

1. toxicity: documents that the Kneser-Ney models reject go.
2. near duplicates: of each group of documents whose sets of five-word
   shingles are alike to 80 % one stays, that with the least doc_id.
3. decontamination: documents in which ten words of a benchmark item occur in a
   row go.
4. secrets: the secrets found are replaced by a mark; no document goes.
5. mixing: sources are weighed 5, 2, 1 and sampled; documents without a copy in
   the mix go.

SQL can't express the models of stages 1 and 4, so there is no ORACLE_SQL; the
tests compare the whole run with a plain version.

Edge cases: null and empty texts are toxic only if the labels say so of most
texts, are nobody's copies and contain nothing, so they pass stages 1 to 4, and
the mix, which takes words, has none of them unless a copy is certain; null
ids and sources are kept as they are; of rows that repeat in id and text one
stays; extra columns go through all stages, but for those named size,
source_size, target, copies and taken, which the mix replaces; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, neardup, secrets, toxicity
from quillspark.scratch import materialize
from quillspark.shipping import ship_package

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sources and sinks: pages, JSON, JSON lines, vectors, graphs, question banks, evaluation runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.commits import Commits

CHUNK = "id string, parent_id string, chunk_index int, chunk_total int, source string, type string, statute string, title string, text string, date string, superseded_by string, references array<string>, file_path string"
VERTEX = "id string, source string, type string, statute string, title string, date string, chunk_count int"
EDGE = "from string, to string, relation string, confidence double, ref_key string, llm_typed boolean"
EXTRACTION = "from string, to string, relation string, confidence double, reasoning string, model string"
QUESTIONS = "entries array<struct<id string, tier string, question string, answer string, answer_key_facts array<string>>>"
EVAL_RUN = "results array<struct<id string, tier string, fact_score double, has_citation boolean, facts_covered int, facts_total int>>, overall_fact_coverage double, overall_citation_rate double"


def scan_html(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of all HTML files below ``root``; bytes that aren't UTF-8 become U+FFFD, unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").option("ignoreCorruptFiles", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), f"^\\Q{base}\\E/", "")
    return files.select(path.alias("path"), F.expr("make_valid_utf8(cast(content as string))").alias("raw"))


def number_documents(docs: DataFrame, first_source: str, path: str = "path") -> DataFrame:
    """Adds ``doc_ord``: documents of ``first_source`` first, then by path.  A distributed sort and a count for each range."""
    spark = docs.sparkSession
    ordered = docs.withColumn("__first", F.when(F.startswith(path, F.lit(first_source + "/")), 0).otherwise(1)).repartitionByRange("__first", path).sortWithinPartitions("__first", path)
    ordered = ordered.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33))
    sizes = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}  # one row for each partition
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = spark.createDataFrame(offsets or [(0, 0)], "__p long, __off long")
    return ordered.join(F.broadcast(table), "__p").withColumn("doc_ord", F.col("__off") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__first", "__id", "__p", "__off")


def read_json_array(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """JSON lines; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of its schema where it doesn't exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # Spark's analysis errors have no common Python type
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def slim_parents(parents: DataFrame) -> DataFrame:
    """Parents as they are stored: without their lists of chunks."""
    return parents.drop("chunk_ids")


def vertices(parents: DataFrame) -> DataFrame:
    return parents.select("id", "source", "type", "statute", "title", "date", F.size("chunk_ids").alias("chunk_count"))


def content(table: DataFrame) -> dict[str, str]:
    """What tells a table from others: the number of its rows, and the sum and the exclusive or of their hashes, nulls included."""
    h = F.xxhash64(*table.columns, *[F.col(c).isNull() for c in table.columns])
    row = table.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return {k: str(row[k]) for k in ("n", "s", "x")}


def build_once(spark: SparkSession, path: str, version: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored index, built if it is absent or if the content it was built from has changed.

    ``version`` is the source table.  Each build has a folder of its own that a
    commit names, so that readers of the one before keep what they hold, and of two builders one is taken.
    """
    told, commits = content(version), Commits(spark, path)
    while True:
        number, last = commits.latest()
        if last is not None and last["content"] == told:
            return spark.read.parquet(f"{path}/{last['folder']}")
        folder = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{folder}")
        commits.take(number + 1, {"folder": folder, "content": told})


def write_vectors(vectors: DataFrame, path: str, shards: int = 1, order: str = "chunk_ord") -> None:
    """Vectors in contiguous shards of equal size by ``order``, one folder for each."""
    n = vectors.count()
    per = max(1, -(-n // shards))
    vectors.withColumn("shard", F.floor(F.col(order) / per).cast("int")).repartition("shard").sortWithinPartitions(order).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_gaps(vectors: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """The shards that aren't contiguous: (shard, lo, hi, n)."""
    return vectors.groupBy("shard").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("n")).where("hi - lo + 1 != n")


def read_questions(spark: SparkSession, path: str, tier: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """The entries of a question bank; key facts default to the answer itself."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", "true").json(path).select(F.explode("entries").alias("e")).select("e.*")
    rows = rows if tier is None else rows.where(F.col("tier") == tier)
    rows = rows if ids is None else rows.where(F.col("id").isin(ids))
    return rows.withColumn("answer_key_facts", F.coalesce("answer_key_facts", F.array("answer")))


def missing_ids(questions: DataFrame, ids: list[str]) -> DataFrame:
    """Wanted ids that no question bears."""
    wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("id", T.StringType())]))
    return wanted.join(questions, "id", "left_anti")


def newest_run(spark: SparkSession, pattern: str) -> DataFrame:
    """The results of the last evaluation run by file name."""
    rows = spark.read.schema(EVAL_RUN).option("multiLine", "true").json(pattern).withColumn("file", F.col("_metadata.file_name"))
    last = rows.agg(F.max("file").alias("file"))
    return rows.join(last, "file", "left_semi").select(F.explode("results").alias("r")).select("r.*")

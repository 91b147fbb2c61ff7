"""Re-typing of edges as a stateful stream: each edge keeps what a log has said of it so far.

State is keyed by (from, to): the lines of the log that concern an edge so far, as
a set.  A micro-batch adds its lines; the edges they touch are joined with the
assembled ones and settled anew from all their lines in the lines' order, so these may
come late, out of order or twice, and any split of
the log ends with the same edges.  Each batch puts out the edges it touched
(update mode), with the counters of their lines; ``settled`` takes the last word on
each edge, ``counters`` sums up.  All of it are native expressions: no row
and no state leaves the JVM.

An edge's lines fit in memory: a log has a few for each.  Edges that no line
concerns have no output and stay as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from quillspark.profile import DEFAULT, Profile
from quillspark.sources.commits import Commits

#: Relations that replace an edge's own, and counters, as ``graph.retype`` has them: fixed values.
TYPED = ("interpreted_by", "clarified_by", "overrides")
COUNTERS = ("dropped_none", "retyped", "kept_references", "low_conf_skipped", "missing_edge")

CHANGED = "from string, to string, known boolean, deleted boolean, relation string, confidence double, llm_typed boolean, " + ", ".join(f"{c} long" for c in COUNTERS)
LOG = "line long, from string, to string, relation string, confidence double"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _settle(profile: Profile) -> Column:
    """The edge (known, r, c) after all its ``lines``, and how many of them did what."""
    s = F.array_sort("lines")
    s = F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i + 1)["line"] == x["line"], F.lit(False)))  # a line number counts once
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(False).alias("deleted"), F.col("r").alias("relation"), F.col("c").alias("confidence"), F.lit(False).alias("llm_typed"), *[zero.alias(c) for c in COUNTERS])

    def step(acc: Column, x: Column) -> Column:
        live = F.col("known") & ~acc["deleted"]
        sure = live & F.coalesce(x["confidence"] >= profile.confidence_floor, F.lit(False))
        said = lambda *names: sure & F.coalesce(x["relation"].isin(*names), F.lit(False))
        none, typed, kept = said("none"), said(*TYPED), said("references")
        low = live & ~sure & x["confidence"].isNotNull()
        told = dict(zip(COUNTERS, (none, typed, kept, low, ~live)))
        return F.struct(
            (acc["deleted"] | none).alias("deleted"), F.when(typed, x["relation"]).otherwise(acc["relation"]).alias("relation"),
            F.when(typed, x["confidence"]).when(kept, F.least(acc["confidence"], F.lit(profile.reference_ceiling))).otherwise(acc["confidence"]).alias("confidence"),
            (acc["llm_typed"] | typed | kept).alias("llm_typed"), *[(acc[c] + told[c].cast("long")).alias(c) for c in COUNTERS],
        )

    return F.aggregate(s, start, step)


def changed_edges(log: DataFrame, edges: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """The stream of edges (``CHANGED``) that each micro-batch of ``log`` (line, from, to, relation, confidence) touches."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    told = log.groupBy("from", "to").agg(F.collect_set(F.struct("line", "relation", "confidence")).alias("lines"))
    first = edges.select("from", "to", F.lit(True).alias("known"), F.col("relation").alias("r"), F.col("confidence").cast("double").alias("c"))
    rows = told.join(first, ["from", "to"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.withColumn("s", _settle(profile)).select("from", "to", "known", *[f"s.{c}" for c in ("deleted", "relation", "confidence", "llm_typed", *COUNTERS)])


def run_to_end(changed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what is there; each batch becomes one commit of ``target``, whose number follows the batch's, so a repeated batch changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        commits = Commits(batch.sparkSession, target)
        if number + 1 not in commits.numbers():
            folder = f"batch-{number:012d}"
            batch.write.mode("overwrite").parquet(f"{target}/{folder}")
            commits.take(number + 1, {"folder": folder})

    return changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_words(spark: SparkSession, target: str) -> DataFrame:
    """The last state (``CHANGED``) of each touched edge."""
    out = spark.createDataFrame([], CHANGED + ", batch long")
    for n in (commits := Commits(spark, target)).numbers():
        rows = spark.read.schema(CHANGED).parquet(f"{target}/{commits.read(n)['folder']}")
        out = out.unionByName(rows.withColumn("batch", F.lit(n).cast("long")))
    newest = F.row_number().over(W.partitionBy("from", "to").orderBy(F.desc("batch")))
    return out.withColumn("__n", newest).where("__n = 1").drop("__n", "batch")


def settled(edges: DataFrame, words: DataFrame) -> DataFrame:
    """The edges after the log, as ``graph.retype`` returns them."""
    new = words.where("known").select("from", "to", "deleted", F.col("relation").alias("r"), F.col("confidence").alias("c"), "llm_typed")
    rows = edges.join(new, ["from", "to"], "left").where("not coalesce(deleted, false)")
    return rows.select("from", "to", F.coalesce("r", "relation").alias("relation"), F.coalesce("c", "confidence").alias("confidence"), "ref_key", F.coalesce("llm_typed", F.lit(False)).alias("llm_typed"), "adj_ord")


def counters(words: DataFrame) -> DataFrame:
    return words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])

"""Corpus statistics and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.profile import DEFAULT, Profile


def corpus_stats(chunks: DataFrame, top: int = 10) -> DataFrame:
    """(kind, name, n, value): counts by type, by source and by the most frequent statutes, mean length, share with references.

    One pass: grouping sets share the scan and its partial aggregates.
    """
    has = (F.size("references") > 0).cast("int")
    rows = chunks.select("type", "source", "statute", F.length("text").alias("len"), has.alias("has"))
    rows = rows.groupingSets([["type"], ["source"], ["statute"], []], "type", "source", "statute").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("len"), F.avg("has").alias("has"), F.grouping_id().alias("g"))
    by = lambda g, c, kind: rows.where(F.col("g") == g).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n", F.lit(None).cast("double").alias("value"))
    statutes = by(6, "statute", "statute").where("name is not null").orderBy(F.desc("n"), "name").limit(top)
    whole = rows.where("g = 7")
    mean = whole.select(F.lit("mean_length").alias("kind"), F.lit(None).cast("string").alias("name"), "n", F.round("len", 6).alias("value"))
    share = whole.select(F.lit("share_with_references").alias("kind"), F.lit(None).cast("string").alias("name"), "n", F.round("has", 6).alias("value"))
    return by(3, "type", "type").unionByName(by(5, "source", "source")).unionByName(statutes).unionByName(mean).unionByName(share)


def parent_stats(parents: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """One row: parents, authority parents, court cases and distinct statutes among statutory sources."""
    statutory = F.col("source") == profile.statute_source
    return parents.agg(
        F.count(F.lit(1)).alias("total_parents"),
        F.count_if(F.col("source") == profile.authority_source).alias("authority_total"),
        F.count_if(statutory & (F.coalesce("type", F.lit("UNKNOWN")) == "COURT_CASE")).alias("court_total"),
        F.count_distinct(F.when(statutory & (F.col("statute") != ""), F.col("statute"))).alias("statute_count"),
    )


def statute_counts(parents: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    rows = parents.where((F.col("source") == profile.statute_source) & (F.coalesce("statute", F.lit("")) != ""))
    return rows.groupBy("statute").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def score_answers(judged: DataFrame, answers: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(id, tier, fact_score, has_citation, facts_covered, facts_total, passed) from judged facts (id, covered) and answers (id, tier, answer)."""
    facts = judged.groupBy("id").agg(F.count_if("covered").alias("facts_covered"), F.count(F.lit(1)).alias("facts_total"))
    rows = answers.join(facts, "id", "left").na.fill(0, ["facts_covered", "facts_total"])
    score = F.when(F.col("facts_total") > 0, F.col("facts_covered") / F.col("facts_total")).otherwise(F.lit(0.0))
    return rows.select("id", "tier", score.alias("fact_score"), T.has_citation(F.col("answer"), profile).alias("has_citation"), "facts_covered", "facts_total", (score >= 0.5).alias("passed"))


def tier_report(results: DataFrame) -> DataFrame:
    """Means by tier, and over all questions in the row of tier null."""
    return results.rollup("tier").agg(F.round(F.avg("fact_score"), 6).alias("fact_coverage"), F.round(F.avg(F.col("has_citation").cast("int")), 6).alias("citation_rate"), F.count(F.lit(1)).alias("n"))


def eval_buckets(results: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(bucket, n, pct, color): tiers joined to buckets; per cent rounded half to even."""
    bucket = F.coalesce(*[F.when(F.col("tier").isin(*tiers), F.lit(name)) for name, tiers in profile.tier_buckets])
    rows = results.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("fact_score") * 100, 0).cast("int").alias("pct"))
    return rows.withColumn("color", F.when(F.col("pct") >= 55, "green").when(F.col("pct") >= 30, "amber").otherwise("red"))


def embedding_bytes(vectors: DataFrame) -> DataFrame:
    return vectors.agg((F.sum(F.size("embedding")) * 4).cast("long").alias("n_bytes"), F.count(F.lit(1)).alias("n"))


def index_check(vectors: DataFrame, dim: int) -> DataFrame:
    """One row of checks: rows, rows of another dimension, rows that aren't of unit length."""
    norm = F.sqrt(T.dot(F.col("embedding"), F.col("embedding")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != dim).alias("bad_dim"), F.count_if(F.abs(norm - 1) > 1e-3).alias("not_unit"))


def order_check(vectors: DataFrame, other: DataFrame, key: str, order: str = "vec_ord") -> DataFrame:
    """One row: places of either table, those where the ids differ, and whether both are in one order."""
    a, b = vectors.select(order, F.col(key).alias("a")), other.select(order, F.col(key).alias("b"))
    both = a.join(b, order, "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ")).withColumn("same_order", F.col("n_differ") == 0)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that is filled while it is written, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def throughput(seen: Observation, seconds: float) -> dict[str, float]:
    """Rows, seconds and rows a second of an observed write."""
    rows = seen.get["rows"]
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds > 0 else 0.0}


def paired_report(runs: dict[str, DataFrame], base: str) -> DataFrame:
    """(mode, tier, fact_coverage, citation_rate, n, n_paired, gain): each mode's report, and its mean gain over ``base`` on the questions that both answered."""
    out = None
    for mode, results in runs.items():
        ref = runs[base].select("id", F.col("fact_score").alias("base_score"))
        rows = results.join(ref, "id", "left")
        report = rows.rollup("tier").agg(
            F.round(F.avg("fact_score"), 6).alias("fact_coverage"), F.round(F.avg(F.col("has_citation").cast("int")), 6).alias("citation_rate"), F.count(F.lit(1)).alias("n"),
            F.count("base_score").alias("n_paired"), F.round(F.avg(F.col("fact_score") - F.col("base_score")), 6).alias("gain"),
        )
        report = report.select(F.lit(mode).alias("mode"), "*")
        out = report if out is None else out.unionByName(report)
    return out

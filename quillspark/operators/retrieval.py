"""Hybrid retrieval: fused rankings, reference and neighbour expansion, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.operators import ranking as R
from quillspark.profile import DEFAULT, Profile
from quillspark.scratch import materialize


def fused_hits(vector: DataFrame, lexical: DataFrame, chunks: DataFrame, profile: Profile = DEFAULT, rrf_k: int | None = None) -> DataFrame:
    """(qid, id, score, fuse_ord): both lists (qid, id, rnk) fused and boosted.

    ``fuse_ord`` is the order in which a walk over the vector list, then over
    what only the lexical list has, first meets the hit.
    """
    k = profile.rrf_k if rrf_k is None else rrf_k
    both = vector.select("qid", "id", "rnk", F.lit(0).alias("of")).unionByName(lexical.select("qid", "id", "rnk", F.lit(1).alias("of")))
    fused = both.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rnk"))).alias("rrf"), F.min(F.struct("of", "rnk")).alias("seen"))
    fused = fused.withColumn("fuse_ord", F.row_number().over(W.partitionBy("qid").orderBy("seen")).cast("long") - 1)
    about = chunks.select("id", "source")
    return fused.join(about, "id").select("qid", "id", (F.col("rrf") * R.boost(F.col("source"), F.col("id"), profile)).alias("score"), "fuse_ord")


def expand(hits: DataFrame, chunks: DataFrame, sections: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(qid, id, score, tie): hits, what they cite and their neighbours.

    In the order of ``fuse_ord``, a hit's own score counts by maximum, while
    cited chunks and neighbours get a share of it only where nothing came
    before.  As sets: the first candidate of an id in (fuse_ord, kind, i, j)
    gives its score, and direct hits can only raise it.
    """
    direct = hits.select("qid", "id", "score", F.struct("fuse_ord", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("ord"), F.col("score").alias("own"))
    cited = hits.join(chunks.select("id", F.slice("references", 1, profile.refs_per_hit).alias("refs")), "id")
    cited = cited.select("qid", "score", "fuse_ord", F.posexplode("refs").alias("i", "ref_key"))
    cited = cited.join(sections.where(F.col("pos") < profile.targets_per_ref), "ref_key")
    none = F.lit(None).cast("double")
    refs = cited.select("qid", F.col("chunk_id").alias("id"), (F.col("score") * profile.ref_decay).alias("score"), F.struct("fuse_ord", F.lit(1).alias("kind"), "i", F.col("pos").cast("int").alias("j")).alias("ord"), none.alias("own"))
    span = profile.neighbour_span
    long = hits.where(F.contains("id", F.lit(profile.long_marker)) & F.col("id").rlike(r"#chunk\d+$"))
    near = long.select("qid", "score", "fuse_ord", F.regexp_extract("id", r"(?s)^(.*)#chunk\d+$", 1).alias("base"), F.regexp_extract("id", r"#chunk(\d+)$", 1).cast("int").alias("at"))
    near = near.select("*", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("off")).where("off != 0")
    near = near.withColumn("id", F.concat("base", F.lit("#chunk"), (F.col("at") + F.col("off")).cast("string"))).join(chunks.select("id"), "id", "left_semi")
    nbrs = near.select("qid", "id", (F.col("score") * profile.neighbour_decay).alias("score"), F.struct("fuse_ord", F.lit(2).alias("kind"), F.col("off").alias("i"), F.lit(0).alias("j")).alias("ord"), none.alias("own"))
    every = direct.unionByName(refs).unionByName(nbrs)
    return every.groupBy("qid", "id").agg(F.greatest(F.min_by("score", "ord"), F.max("own")).alias("score"), F.min("ord").alias("tie"))


def rank_hits(expanded: DataFrame, chunks: DataFrame, k: int, profile: Profile = DEFAULT, digits: int = 9) -> DataFrame:
    """The chunks of the ``k`` best hits with ``score`` and ``rank``: current ones first, then by score, capped by parent."""
    old = F.when(F.coalesce("superseded_by", F.lit("")) != "", 1).otherwise(0)
    rows = expanded.join(chunks.select("id", "parent_id", old.alias("old")), "id").withColumn("score", F.round("score", digits))
    kept = R.parent_cap(rows, [F.col("old"), F.desc("score"), F.col("tie")], R.cap_of(F.col("id"), profile), k).drop("old", "parent_id")
    return kept.join(chunks, "id")  # texts only of what is left


def retrieve(vector: DataFrame, lexical: DataFrame, chunks: DataFrame, sections: DataFrame, k: int = 10, pool: int = 50, dedup: str = "post", rrf_k: int | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """Hybrid retrieval for all queries in one plan.

    ``vector`` and ``lexical`` are ranked lists (qid, id, rnk) of at least
    ``pool`` (before-fusion deduplication: 3 times ``pool``) hits a query.
    """
    if dedup == "pre":
        wide = lambda x: R.first_per_parent(x.where(F.col("rnk") < 3 * pool).join(chunks.select("id", "parent_id"), "id"), min(pool, 40)).select("qid", "id", "rnk")
        vector, lexical = wide(vector), wide(lexical)
    else:
        vector, lexical = vector.where(F.col("rnk") < pool), lexical.where(F.col("rnk") < pool)
    hits = materialize(fused_hits(vector, lexical, chunks, profile, rrf_k), "hits")  # 2 * pool rows a query, read thrice
    return rank_hits(expand(hits, chunks, sections, profile), chunks, k, profile)

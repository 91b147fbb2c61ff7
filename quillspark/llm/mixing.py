"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Within a source documents have
unequal chances: the expected copies of a document are proportional to the
number of binary digits of its size (long documents are likelier than scraps),
and ``cap`` at most; the factor is the one with which the expected words of the
source are its target.  A document with ``e`` expected copies is taken
``floor(e)`` times for certain, and the rest of the target is filled by a Pareto
order sample: with inclusion odds ``p / (1 - p)``, ``p`` being the fraction of
``e``, and random odds ``u / (1 - u)``, a document ranks by the quotient of the two,
and documents are taken in that order.  The sample's fixed size is counted in
words: it ends at the document whose inclusion or omission comes nearest to the
rest of the target, so the words taken from a source differ from its target by
at most half of one document.

The order is global in a source, which may hold a third of all rows, so it is
never sorted as a whole.  Quotients are mapped monotonically to ``buckets``
ranges, the words of each (source, bucket) are summed before any shuffle, and
the one bucket of each source in which the target is reached is divided in the
same way again; only the rows of one such fine bucket (a 65,536th of a source, at
the default) are sorted.
Sources may be as many as hosts: they are numbered by a distributed sort, and the
targets are found by aggregates, so that no task holds all of them.

Random numbers are the leading bits of ``md5(seed:doc_id)``; reruns agree
whatever the partitioning.

Edge cases: null texts have size 0; null sources form one source, last in
order; rows that share a doc_id share a random number and are taken or left
together if they share a size; null doc_ids likewise; without any words all
targets are 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII blanks; null: 0."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each source by code point, null last, from 0.  A distributed sort and a count for each range."""
    placed = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, total = [F.lit(0), F.lit(0)], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        offsets += [F.lit(r.part), F.lit(total)]
        total += r["count"]
    start = F.element_at(F.create_map(*offsets[2:]) if total else F.create_map(*offsets), part)
    return placed.withColumn("rank", (start + place).cast("long")).drop("at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """From (source, source_size): targets by weight, none above ``cap`` times its size.

    The reshared excess settles at one common level of target over weight for
    all sources below their cap.  The level starts with no source capped and
    rises while more of them are; a step is one aggregate over the sources, and
    there are as many steps as the level has stops, a few.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = _numbered(sizes).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    named = materialize(named, "sources")
    want = float(named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * budget
    level, n_capped = None, -1
    while True:
        capped = F.lit(False) if level is None else F.lit(level) > F.col("most") / F.col("weight")
        r = named.agg(F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(capped).alias("n")).first()
        if r.n == n_capped or not r.open:
            break
        level, n_capped = (want - r.full) / r.open, r.n
    target = F.least(F.lit(level or 0.0) * F.col("weight"), F.col("most"))
    return named.select("source", "source_size", target.alias("target"))


def class_shares(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Expected copies of each (source, cls): proportional to ``cls``, at most ``cap``, so that expected words are the target.

    ``classes`` has (source, cls, words).  Classes are capped from the largest
    down; a source has at most 64 of them.
    """
    rows = classes.join(targets.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    before = W.partitionBy("source").orderBy(F.desc("cls")).rowsBetween(W.unboundedPreceding, -1)
    here = W.partitionBy("source")
    pull = F.col("cls") * F.col("words")
    left = F.sum(pull).over(here) - F.coalesce(F.sum(pull).over(before), F.lit(0))
    level = (F.col("target") - F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(float(cap))) / F.when(left > 0, left)
    rows = rows.withColumn("level", F.coalesce(level, F.lit(0.0)))
    rows = rows.withColumn("capped", F.col("level") * F.col("cls") >= F.lit(float(cap)))
    final = F.max(F.when(~F.col("capped"), F.struct("cls", "level"))).over(here)["level"]
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.lit(float(cap))).otherwise(F.least(final * F.col("cls"), F.lit(float(cap))))
    rows = rows.withColumn("e", copies)
    rows = rows.withColumn("sure", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.floor("e"))
    rest = F.col("target") - F.sum(F.col("sure") * F.col("words")).over(here)
    return rows.select("source", "cls", "source_size", "target", "sure", "p", rest.alias("rest"))


def size_class(size: Column) -> Column:
    """Binary digits of a size; 1 for 0."""
    return F.length(F.bin(size)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform number in (0, 1) from the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its line of ``plan``, a table of one row for each source and size class.

    The plan is broadcast if a count finds it small; else Spark joins it, and
    may split a source that holds many rows.
    """
    small = plan.count() <= 20_000
    plan = plan.withColumnsRenamed({"source": "of", "cls": "of_cls"})
    return rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("cls") == F.col("of_cls"))).drop("of", "of_cls")


def _ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the order quotient ``q``, its bucket and its fine bucket, both over all sources' common range."""
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) * ((F.lit(1.0) - F.col("p")) / F.col("p"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds).otherwise(F.lit(float("inf"))))
    most = buckets * buckets - 1
    spot = F.least(F.floor(F.col("q") / (F.col("q") + 1.0) * (most + 1)), F.lit(most))
    rows = rows.withColumn("fine", F.when(F.col("p") > 0, spot).otherwise(F.lit(most)).cast("long"))
    return rows.withColumn("bucket", F.floor(F.col("fine") / buckets).cast("long"))


def _place() -> Column:
    return F.struct("q", F.col("doc_id").isNull().alias("null"), "doc_id")


def _cut(ranked: DataFrame, bucket: str, below: Column) -> DataFrame:
    """(of, whole, cut, below): for each source, the last bucket that its rest takes whole (-1: none), the one it ends in, and the words before that.

    ``below`` are the words before the first of the buckets.
    """
    upto = W.partitionBy("source").orderBy(bucket)
    sums = ranked.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(below).alias("start"))
    sums = sums.withColumn("upto", F.col("start") + F.sum("words").over(upto)).withColumn("below", F.col("upto") - F.col("words"))
    cut = F.max(F.when((F.col("below") < F.col("rest")) & (F.col("upto") > F.col("rest")), F.struct(bucket, "below")))
    cuts = sums.groupBy(F.col("source").alias("of")).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col(bucket))), F.lit(-1)).alias("whole"), cut.alias("c"))
    return materialize(cuts.select("of", "whole", F.col(f"c.{bucket}").alias("cut"), F.col("c.below").alias("below")), "cuts")


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with its source's line of a table, which is broadcast if a count finds it small."""
    small = table.count() <= 20_000
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix_plan(base: DataFrame, weights: tuple[int, ...], budget: float, cap: float, buckets: int) -> DataFrame:
    """One row for each source and size class: target, certain copies, and where the source's sample ends.

    ``base`` has doc_id, source, size, cls, u.  A row is in the sample if its fine
    bucket is at most ``whole``, or if it is in fine bucket ``cut`` and not beyond ``last``.
    """
    classes = materialize(base.groupBy("source", "cls").agg(F.sum("size").alias("words")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    shares = materialize(class_shares(classes, targets, cap), "shares")
    ranked = _ranked(_with_plan(base, shares), buckets)

    coarse = _cut(ranked, "bucket", F.lit(0))
    inside = _with_source(ranked, coarse).where(F.col("bucket") == F.col("cut"))
    fine = _cut(inside, "fine", F.col("below"))
    # ``whole`` counts fine buckets: all of those before the coarse one, and those before the end in it
    found = coarse.join(fine.select(F.col("of").alias("of_"), F.col("whole").alias("w"), F.col("cut").alias("fine_cut"), F.col("below").alias("fine_below")), F.col("of").eqNullSafe(F.col("of_")), "left")
    whole = F.greatest(F.col("whole") * buckets + (buckets - 1), F.coalesce("w", F.lit(-1)))
    cuts = shares.join(found.select("of", whole.alias("whole"), F.col("fine_cut").alias("cut"), F.col("fine_below").alias("below")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    cuts = materialize(cuts, "cuts")

    # The frame is by value: rows that tie are taken or left together.
    near = _with_plan(ranked.drop("source_size", "target", "sure", "p", "rest"), cuts).where((F.col("p") > 0) & (F.col("fine") == F.col("cut"))).withColumn("place", _place())
    near = near.withColumn("incl", F.col("below") + F.sum("size").over(W.partitionBy("source").orderBy("place")))
    near = near.withColumn("excl", F.col("incl") - F.sum("size").over(W.partitionBy("source", "place")))
    ends = near.where(F.col("incl") + F.col("excl") <= F.col("rest") * 2.0).groupBy(F.col("source").alias("of")).agg(F.max("place").alias("last"))
    plan = cuts.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
    return materialize(plan.select("source", "cls", "source_size", "target", "sure", "p", "whole", "cut", "last"), "plan")


def _copies(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    rows = _ranked(_with_plan(rows, plan), buckets)
    inside = (F.col("fine") <= F.col("whole")) | F.coalesce((F.col("fine") == F.col("cut")) & (_place() <= F.col("last")), F.lit(False))
    return rows.withColumn("copies", F.col("sure") + F.when((F.col("p") > 0) & inside, 1).otherwise(0))


def _base(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("u")).withColumn("cls", size_class(F.col("size")))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix", buckets: int = 256) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    base = materialize(_base(docs, seed), "mix")
    told = _copies(base, mix_plan(base, weights, budget, cap, buckets), buckets)
    return told.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix", buckets: int = 256) -> DataFrame:
    """The documents of the mix with all their columns, and size, source_size, target, copies, taken.

    Documents of which no copy is taken are left out; a clashing name among the
    last five is replaced.
    """
    base = materialize(_base(docs, seed), "mix")
    plan = mix_plan(base, weights, budget, cap, buckets)
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("u")
    ).withColumn("cls", size_class(F.col("size")))
    told = _copies(rows, plan, buckets).where("copies > 0").withColumn("taken", F.col("size") * F.col("copies"))
    added = ["size", "source_size", "target", "copies", "taken"]
    return told.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS want, source_size * CAST(2 AS DOUBLE) AS most FROM sizes),
weighed AS (SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM named),
levels AS (
  SELECT *, most / weight AS quotient,
    (want - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY most / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM levels WHERE NOT level > quotient ORDER BY quotient, rk LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level > quotient THEN most ELSE least((SELECT level FROM final) * weight, most) END AS target FROM levels),
classes AS (SELECT source, length(bin(size)) AS cls, CAST(sum(size) AS BIGINT) AS words FROM base GROUP BY ALL),
pulls AS (
  SELECT c.*, t.source_size, t.target, coalesce(sum(words) OVER b, 0) AS before, sum(cls * words) OVER (PARTITION BY c.source) - coalesce(sum(cls * words) OVER b, 0) AS pull
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WINDOW b AS (PARTITION BY c.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT *, CASE WHEN pull > 0 THEN (target - CAST(before AS DOUBLE) * 2) / CAST(pull AS DOUBLE) ELSE 0 END AS lev FROM pulls),
copies AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN lev * cls >= 2 THEN 2 ELSE least(cls * arg_max(lev, cls) FILTER (lev * cls < 2) OVER (PARTITION BY source), 2) END AS e FROM settled),
shares AS (SELECT *, floor(e) AS sure, e - floor(e) AS p, target - CAST(sum(floor(e) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM copies),
ranked AS (
  SELECT b.doc_id, b.source, b.size, s.source_size, s.target, s.sure, s.p, s.rest,
         CASE WHEN s.p > 0 THEN (b.u / (1 - b.u)) * ((1 - s.p) / s.p) ELSE CAST('inf' AS DOUBLE) END AS q
  FROM base b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source AND length(bin(b.size)) = s.cls),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) AS incl, sum(size) OVER (PARTITION BY source, q, doc_id) AS own FROM ranked)
SELECT doc_id, source, size, source_size, target, CAST(sure + extra AS BIGINT) AS copies, CAST(size * (sure + extra) AS BIGINT) AS taken
FROM (SELECT *, CASE WHEN p > 0 AND incl + incl - own <= rest * 2 THEN 1 ELSE 0 END AS extra FROM summed)
"""

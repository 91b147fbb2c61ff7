"""The typed graph of documents: building, re-typing and walking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.operators.corpus import section_places, title_sections
from quillspark.operators.ranking import cap_of
from quillspark.profile import DEFAULT, Profile
from quillspark.scratch import materialize


def build_edges(parents: DataFrame, sections: DataFrame | None = None, profile: Profile = DEFAULT, most: int = 100_000) -> DataFrame:
    """(edge_ord, from, to, relation, confidence, ref_key): citations, then amendments.

    Each reference of a parent has at most ``max_targets`` targets; a target
    that is the parent itself or of another source doesn't count.  Of the targets
    of a key only the first ``max_targets + 1`` are joined, as one of them may be
    the parent itself.  Up to ``most`` keys are broadcast, and then no reference is shuffled.

    ``sections`` (ref_key, pos, parent_id) is the section index; without one, the keys are those of ``parents``.
    """
    amending = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(f"(?iu){profile.amendment}")
    if sections is None:
        places = section_places(parents, profile, "source", "title").select("ref_key", F.col("parent_ord").alias("pos"), F.col("id").alias("to"), F.col("source").alias("to_source"), F.col("title").alias("to_title"))
    else:
        target = parents.select(F.col("id").alias("to"), F.col("source").alias("to_source"), F.col("title").alias("to_title"))
        places = sections.withColumnRenamed("parent_id", "to").join(target, "to")

    def linked(refs: DataFrame, relation: str, confidence: float, phase: int) -> DataFrame:
        fits = F.col("to_source") == profile.statute_source
        fits = fits & ~amending("to_title") if relation == "amends" else fits
        first = materialize(first_places(places.where(fits), profile.max_targets + 1, most), "targets")
        hits = refs.join(F.broadcast(first) if first.count() <= most else first, "ref_key")
        others = F.slice(F.filter("first", lambda x: x["to"] != F.col("id")), 1, profile.max_targets)
        hits = hits.select("*", F.posexplode(others).alias("n", "target"))
        return hits.select(F.struct(F.lit(phase).alias("phase"), F.col("parent_ord").cast("long").alias("p"), F.col("i").cast("int").alias("i"), (F.col("n") + 1).cast("int").alias("n")).alias("edge_ord"), F.col("id").alias("from"), F.col("target.to").alias("to"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), "ref_key")

    cited = parents.select("id", "parent_ord", F.posexplode("references").alias("i", "ref_key"))
    amends = parents.where((F.col("source") == profile.statute_source) & amending("title") & (F.coalesce("statute", F.lit("")) != ""))
    keys = F.array_sort(title_sections(F.col("title"), F.col("statute"), profile), lambda a, b: _by_number(a, b))
    amends = amends.select("id", "parent_ord", F.posexplode(keys).alias("i", "ref_key"))
    return linked(cited, "cites", profile.cites_confidence, 0).unionByName(linked(amends, "amends", profile.amends_confidence, 1))


def first_places(places: DataFrame, n: int, most: int = 100_000, deals: int = 16) -> DataFrame:
    """(ref_key, first): the ``n`` first (pos, to) of each key of (ref_key, pos, to), in order.

    The places of a key are never sorted together, so a task holds no more of a frequent key than of others: they are dealt by
    a hash of ``to``, the n-th of the least places of the deals bounds the n-th place of all, and only what is within it is ordered.
    """
    deal = F.pmod(F.xxhash64("to"), F.lit(max(deals, n)))
    least = places.groupBy("ref_key", deal.alias("deal")).agg(F.min("pos").alias("least"))
    bound = least.groupBy("ref_key").agg(F.get(F.array_sort(F.collect_list("least")), F.lit(n - 1)).alias("bound"))
    bound = materialize(bound, "bounds")
    near = places.join(F.broadcast(bound) if bound.count() <= most else bound, "ref_key").where("bound is null or pos <= bound")
    return near.groupBy("ref_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "to"))), 1, n).alias("first"))


def _by_number(a, b):
    """Order of section keys: by number, then by the whole key."""
    n = lambda c: F.regexp_extract(c, r"§(\d+)", 1).cast("long")
    return F.when(n(a) < n(b), -1).when(n(a) > n(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def assemble(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to): the last attributes, at the place (``adj_ord``) of the first."""
    last = F.max_by(F.struct("relation", "confidence", "ref_key"), F.col("edge_ord")).alias("last")
    merged = edges.groupBy("from", "to").agg(last, F.min("edge_ord").alias("adj_ord"))
    return merged.select("from", "to", "last.relation", "last.confidence", "last.ref_key", "adj_ord")


def retype(edges: DataFrame, log: DataFrame, profile: Profile = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The edges after a log (line, from, to, relation, confidence) of extractions, and counters.

    In the order of lines: a confident ``none`` deletes the edge, and what comes
    later counts as missing; other confident relations retype it; a confident
    ``references`` lowers the confidence only; what is below the floor is left.
    """
    floor = profile.confidence_floor
    sure = F.col("confidence") >= floor
    known = log.join(edges.select("from", "to", F.lit(1).alias("known")), ["from", "to"], "left")
    gone = known.where(F.col("known").isNotNull() & (F.col("relation") == "none") & sure).groupBy("from", "to").agg(F.min("line").alias("gone"))
    rows = known.join(gone, ["from", "to"], "left")
    missing = F.col("known").isNull() | (F.col("line") > F.col("gone"))
    rows = rows.withColumn("missing", F.coalesce(missing, F.lit(False)))
    live = rows.where("not missing")
    typed = F.col("relation").isin("interpreted_by", "clarified_by", "overrides")
    counters = rows.agg(
        F.count_if(~F.col("missing") & sure & (F.col("relation") == "none")).alias("dropped_none"),
        F.count_if(~F.col("missing") & sure & typed).alias("retyped"),
        F.count_if(~F.col("missing") & sure & (F.col("relation") == "references")).alias("kept_references"),
        F.count_if(~F.col("missing") & ~sure).alias("low_conf_skipped"),
        F.count_if("missing").alias("missing_edge"),
    )
    steps = live.where(sure & (typed | (F.col("relation") == "references"))).groupBy("from", "to").agg(F.array_sort(F.collect_list(F.struct("line", "relation", "confidence"))).alias("steps"))
    out = edges.join(gone, ["from", "to"], "left").where("gone is null").drop("gone").join(steps, ["from", "to"], "left")
    start = F.struct("relation", "confidence", F.lit(False).alias("llm_typed"))

    def step(acc, s):
        lowered = F.struct(acc["relation"].alias("relation"), F.least(acc["confidence"], F.lit(profile.reference_ceiling)).alias("confidence"), F.lit(True).alias("llm_typed"))
        return F.when(s["relation"] == "references", lowered).otherwise(F.struct(s["relation"].alias("relation"), s["confidence"].alias("confidence"), F.lit(True).alias("llm_typed")))

    state = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step))
    out = out.withColumn("state", state).select("from", "to", "state.relation", "state.confidence", "ref_key", "state.llm_typed", "adj_ord")
    return out, counters


def pairs_to_type(edges: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Distinct citing pairs, without those that a log already has."""
    pairs = edges.where("relation = 'cites'").select("from", "to").distinct()
    return pairs if done is None else pairs.join(done.select("from", "to"), ["from", "to"], "left_anti")


def sample_exact(rows: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), by a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])), *key).limit(n)


def adjacency(edges: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(id, next, relation, adj_ord, dir): where a walk may go from each node, forward and back in one table, sorted by node."""
    out = edges.where(F.col("relation").isin(*profile.hop_relations)).select(F.col("from").alias("id"), F.col("to").alias("next"), "relation", "adj_ord", F.lit(0).alias("dir"))
    back = edges.where("relation = 'amends'").select(F.col("to").alias("id"), F.col("from").alias("next"), F.lit("amends (newer)").alias("relation"), "adj_ord", F.lit(1).alias("dir"))
    return out.unionByName(back).repartitionByRange("id").sortWithinPartitions("id")


def walk(entries: DataFrame, edges: DataFrame, hops: int = 2, profile: Profile = DEFAULT, steps: DataFrame | None = None, most: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """Bounded breadth-first walk for all queries: (qid, id, hop, ord) visited and (qid, hop, ord, from, to, relation) logged.

    ``entries`` has (qid, id, f_ord).  Nodes of the frontier are taken in order;
    each visits its successors by allowed relations, then the sources of
    ``amends`` edges that point at it.  A hop stops after the node with which
    ``frontier_cap`` new nodes are reached; the next frontier is the first
    ``frontier_cap`` of them.  The first frontier has no cap.

    ``steps`` is the stored ``adjacency``.  A hop moves the frontier, not the edges: up to ``most`` of its rows are
    broadcast; beyond that the join is shuffled.  What was visited is never broadcast, since it grows with the nodes' degrees.
    """
    cap = profile.frontier_cap
    steps = adjacency(edges, profile) if steps is None else steps
    visited = materialize(entries.select("qid", "id", F.lit(0).alias("hop"), F.col("f_ord").cast("long").alias("ord")), "visited")
    frontier, logs = visited, None
    for hop in range(1, hops + 1):
        kept = _hop(steps, frontier.select("qid", "id", F.col("ord").alias("f")), visited.select("qid", F.col("id").alias("next")), cap, most)
        ends = F.when(F.col("relation") == "amends (newer)", F.struct(F.col("next").alias("from"), F.col("at").alias("to"))).otherwise(F.struct(F.col("at").alias("from"), F.col("next").alias("to")))
        log = kept.select("qid", F.lit(hop).alias("hop"), "ord", ends.alias("e"), "relation").select("qid", "hop", "ord", "e.from", "e.to", "relation")
        logs = log if logs is None else logs.unionByName(log)
        visited = visited.unionByName(kept.select("qid", F.col("next").alias("id"), F.lit(hop).alias("hop"), "ord"))
        frontier = kept.where(F.col("ord") < cap).select("qid", F.col("next").alias("id"), F.lit(hop).alias("hop"), "ord")
    return visited, logs


def _hop(steps: DataFrame, frontier: DataFrame, visited: DataFrame, cap: int, most: int) -> DataFrame:
    """(qid, next, at, relation, ord): the new nodes of one hop from ``frontier`` (qid, id, f); ``visited`` has (qid, next).

    The frontier is taken in rounds, as a hop stops early where nodes of high degree are: a round takes the nodes of each query
    before which fewer than ``budget`` steps lead away, and only queries with too few new nodes go on, with 8 times the budget.
    So what is reached stays near what is kept.
    """
    moved = F.broadcast if frontier.count() <= most else lambda df: df
    degree = steps.join(moved(frontier.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    left, found, budget = materialize(frontier.join(degree, "id").withColumn("got", F.lit(0).cast("long")), "frontier"), None, 8 * cap
    while True:
        earlier = F.coalesce(F.sum("degree").over(W.partitionBy("qid").orderBy("f").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        left = left.withColumn("earlier", earlier)
        taken = left.where(F.col("earlier") < budget)
        place = F.struct("f", "dir", "adj_ord").alias("place")
        reached = steps.join(moved(taken.select("qid", "id", "f", "got")), "id").select("qid", "next", F.struct(place, F.col("id").alias("at"), "relation", "got").alias("m"))
        seen = visited if found is None else visited.unionByName(found.select("qid", "next")).join(moved(taken.select("qid").distinct()), "qid", "left_semi")
        both = reached.withColumn("seen", F.lit(False)).unionByName(seen.withColumn("seen", F.lit(True)), allowMissingColumns=True)
        first = both.repartition("qid").groupBy("qid", "next").agg(F.min("m").alias("m"), F.bool_or("seen").alias("seen")).where("not seen")
        first = first.select("qid", "next", "m.at", "m.relation", "m.got", "m.place", F.col("m.place.f").alias("f"))
        before = F.col("got") + F.rank().over(W.partitionBy("qid").orderBy("f")) - 1
        nth = F.col("got") + F.row_number().over(W.partitionBy("qid").orderBy("place")) - 1
        kept = first.withColumn("before", before).withColumn("ord", nth.cast("long")).where(F.col("before") < cap)
        kept = materialize(kept.select("qid", "next", "at", "relation", "ord"), "hop")
        found = kept if found is None else found.unionByName(kept)
        more = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
        rest = left.where(F.col("earlier") >= budget).drop("earlier").join(more, "qid", "left")
        left = rest.withColumn("got", F.col("got") + F.coalesce("more", F.lit(0))).drop("more").where(F.col("got") < cap)
        left, budget = materialize(left, "frontier"), 8 * budget
        if left.isEmpty():
            return found


def order_parents(visited: DataFrame, parents: DataFrame, profile: Profile = DEFAULT, newest_first: bool = False) -> DataFrame:
    """(qid, id, parent_ord): entries in their order, then expanded parents by type and date.

    By default dates sort by their first character downwards and then as text
    upwards; ``newest_first`` sorts them downwards throughout.
    """
    about = parents.select("id", "type", F.coalesce(F.when(F.col("date") != "", F.col("date")), F.lit("0000-00-00")).alias("d"))
    rows = visited.join(about, "id", "left").withColumn("d", F.coalesce("d", F.lit("0000-00-00")))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in profile.type_priority for x in pair]), F.col("type")), F.lit(3))
    entry = F.col("hop") == 0
    dates = [F.when(~entry, F.col("d")).desc_nulls_first()] if newest_first else [F.when(~entry, F.ascii("d")).desc_nulls_first(), F.when(~entry, F.col("d")).asc_nulls_first()]
    order = [F.when(entry, 0).otherwise(1), F.when(entry, F.col("ord")).asc_nulls_first(), F.when(~entry, rank).asc_nulls_first(), *dates, F.col("id")]
    return rows.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy(*order)).cast("long").alias("parent_ord"))


def reexpand(ordered: DataFrame, chunks: DataFrame, matched: DataFrame, k: int, profile: Profile = DEFAULT, order: str = "chunk_ord") -> DataFrame:
    """The chunks of the ordered parents: matched ones first, capped by parent, ``k`` a query; ``rank`` from 1."""
    rows = ordered.select("qid", F.col("id").alias("parent_id"), "parent_ord").join(chunks.select("parent_id", "id", F.col(order).alias("at")), "parent_id")
    rows = rows.join(matched.select("qid", "id", F.col("rank").alias("m")), ["qid", "id"], "left")
    nth = F.row_number().over(W.partitionBy("qid", "parent_id").orderBy(F.col("m").asc_nulls_last(), "at")).cast("long")
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= cap_of(F.col("parent_id"), profile))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("parent_ord", "nth")).cast("long")).where(F.col("rank") <= k)
    return rows.drop("nth", "m", "at", "parent_id").join(chunks, "id")  # texts only of what is left


def retrieve_with_graph(entries: DataFrame, chunks: DataFrame, parents: DataFrame, edges: DataFrame, k: int = 10, hops: int = 2, profile: Profile = DEFAULT, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits and walk log from ``entries``: retrieved hits (qid, id, parent_id, rank), ``entry_multiple`` times ``k`` of them a query."""
    first = entries.groupBy("qid", F.col("parent_id").alias("id")).agg(F.min("rank").alias("f_ord"))
    visited, log = walk(first, edges, hops, profile, steps)
    return reexpand(order_parents(visited, parents, profile), chunks, entries, k, profile), log


def type_pairs(pairs: DataFrame, excerpts: DataFrame, classify, schema: str) -> DataFrame:
    """Pairs classified by a function of Arrow batches, with both excerpts; pairs with an empty one are skipped."""
    a = excerpts.select(F.col("id").alias("from"), F.col("title").alias("from_title"), F.col("excerpt").alias("from_text"))
    b = excerpts.select(F.col("id").alias("to"), F.col("title").alias("to_title"), F.col("excerpt").alias("to_text"))
    both = pairs.join(a, "from").join(b, "to").where((F.length(T.strip(F.col("from_text"))) > 0) & (F.length(T.strip(F.col("to_text"))) > 0))
    return both.mapInArrow(classify, schema)

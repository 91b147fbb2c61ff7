"""Connected components of a link table, without ever holding it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of ``links`` (a, b).

    Alternates large-star and small-star (Kiveris et al.), each an aggregate
    with partial sums and an equi-join, until no link changes: every larger
    neighbour of a node is linked to the smallest node around it, then every
    smaller one and the node itself.  Links then form stars around the smallest
    nodes.  Roots are hooked too, so that long chains take few rounds, and there
    is no cap on these.  A hub of many links is the skewed side of a plain
    equi-join, which Spark splits.  Each round is written to the shared folder;
    that nothing changed is seen from an order-free sum over the distinct links.

    Components found before can stand for the links they were made of: (node,
    component) pairs are links like others, and spare rounds.  Self-links are
    allowed; nulls are dropped; an empty table gives no rows.
    """
    links = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    stars, before = links.where("a > b"), None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large-star: neighbours above a node go to the least of it and its neighbours
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, "links")
        # small-star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        below = large.join(least, F.col("a") == F.col("node"))
        small = below.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        stars = materialize(small.distinct(), "links")
    return materialize(nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component")), "labels")

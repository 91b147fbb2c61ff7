"""Ball k-means: exact Lloyd rounds in which vectors meet only the centroids that can matter.

Vectors are turned into integers, ``floor(scale * x)``, so that distances, sums and
means are exact and results don't depend on partitions.  A cluster is a ball: its
centroid and the distance of its farthest member.  If a vector is at distance d
from its own centroid, a centroid more than 2 d away from that one can't be
nearer.  So the centroids around a ball are sorted by distance once for each
round; those within twice its radius are its neighbours.  Members closer than
half of the way to the first neighbour are the stable core and stay without a
comparison, the others fall into annuli by the number of neighbours within
twice their own distance, and each annulus is compared with these neighbours
exactly.  Annuli are as wide as a doubling of that number, and a ball's
radius is that of its members in the task's block, which is never greater than
the whole ball's.

A round is one pass over the stored table of vectors and clusters, which writes
the next one, and one aggregate of sums that are partial before the shuffle.
Only centroids (k vectors, a parameter) come to the driver and are broadcast; no vector is shuffled.
A table is complete before the next round starts, so a lost
executor repeats tasks of one round.

Edge cases: null vectors, vectors of another length and those with a null or
non-finite component are left out; fewer vectors than k are as many centroids;
empty tables give empty tables; repeated rows are vectors each; a null id is
clustered, but it is the last to be a first centroid, and of equal ids the
vector that sorts first comes first; other columns are ignored.  Integers whose
squares would leave 64 bits are brought to the nearest one that doesn't (2**26
for 64 components).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import materialize

BLOCK = 16_384
FIRST = "concat('2:', cast(vec_id as string))"
_EXACT = 1 << 53


def most(dim: int) -> int:
    """The greatest magnitude of a component with which four times a squared distance fits in 64 bits."""
    return 1 << (60 - (dim - 1).bit_length()) // 2 - 1


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers."""
    limit = float(most(dim))
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    to_int = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("int")
    return vectors.where("embedding is not null").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", to_int).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    top = max(int(np.abs(m).max(initial=0)) for m in (x, c))
    if 4 * x.shape[1] * top * top < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


class Balls:
    """The centroids of a round and, for each, the others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = squared(centroids, centroids)
        np.fill_diagonal(gaps, -1)
        self.order = np.argsort(gaps, 1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.compared = 0

    def nearest(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest of ``among``; ties fall to the smaller number."""
        among = np.sort(among)
        self.compared += len(x) * len(among)
        d = squared(x, self.centroids[among])
        best = d.argmin(1)
        return among[best], d[np.arange(len(x)), best]

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, whose cluster so far is given, and its squared distance."""
        cluster, distance = cluster.copy(), ((x - self.centroids[cluster]) ** 2).sum(1)
        self.compared += len(x)
        by_ball = np.argsort(cluster, kind="stable")
        cuts = np.searchsorted(cluster[by_ball], np.arange(len(self.centroids) + 1))
        for ball, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            members = by_ball[lo:hi]
            if not len(members):
                continue
            neighbours = int(np.searchsorted(self.gaps[ball], 4 * distance[members].max(), side="right"))
            within = np.searchsorted(self.gaps[ball, :neighbours], 4 * distance[members], side="right")
            width, inner = 1, 0
            while inner < neighbours:
                outer = min(width, neighbours)
                annulus = members[(within > inner) & (within <= outer)]
                if len(annulus):
                    cluster[annulus], distance[annulus] = self.nearest(x[annulus], np.append(self.order[ball, :outer], ball))
                inner, width = outer, 2 * width
        return cluster, distance


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance): ``rows`` with the nearest centroids; their clusters so far, if they have them, save comparisons."""
    handle = rows.sparkSession.sparkContext.broadcast(centroids)
    known = "cluster" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(handle.value)

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["v"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(t.num_rows, -1)
            cluster, distance = balls.assign(x, t["cluster"].to_numpy().astype(np.int64)) if known else balls.nearest(x, np.arange(len(balls.centroids)))
            arrays = [t["vec_id"].combine_chunks(), t["v"].combine_chunks(), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "cluster", "distance"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield done(held)
                held, n = [], 0
        if held:
            yield done(held)

    return rows.select("vec_id", "v", *(["cluster"] if known else [])).mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors, by component; without vectors, as they were."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def ball_k_means(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of all vectors that count, and the centroids."""
    rows = integer_vectors(vectors, dim, scale)
    first = rows.orderBy(F.sha2(F.expr(FIRST), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    if not first:
        return rows.selectExpr("vec_id", "v", "cast(null as int) as cluster", "cast(null as bigint) as distance").limit(0), centroids
    assigned = materialize(assign(rows, centroids), "balls")
    for _ in range(rounds):
        centroids = moved(assigned, centroids)
        assigned = materialize(assign(assigned, centroids), "balls")
    return assigned, centroids


def cluster_report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row for each vector: vec_id, cluster, distance, cluster_inertia, inertia and the digest of its centroid."""
    spark = assigned.sparkSession
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    found = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    total = sum(found.values())
    rows = [(c, s, total, digest[c]) for c, s in sorted(found.items())]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """The same by comparing all vectors with all centroids."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
            list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept
            ORDER BY sha256('2:' || vec_id) LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := c)) AS best
            FROM kept x CROSS JOIN c{r} y GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM (
                SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
                FROM a{r} JOIN kept USING (rid) CROSS JOIN range(1, {dim + 1}) AS g(i) GROUP BY ALL) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(m.v, p.v) AS v FROM c{r} p LEFT JOIN m{r} m ON p.c = m.c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
            CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c{rounds}.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON best.c = c{rounds}.c"""


BALLS_SQL = _sql()

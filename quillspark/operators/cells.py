"""A vector index in cells that answers exactly and reads only the cells that matter.

Vectors are stored in partitions, one for each cell: those nearest to one of
``n_cells`` centres.  The centres are fitted on a bounded sample (``per_cell``
vectors a cell, by the least hash of their key); every vector is indexed.  With its radius r,
the greatest distance of a member, a cell can't hold a greater product with a query
than q.c + |q| r, and none than |q| times its greatest norm.

Cells are visited in the order of that bound, in rounds: first as many as hold k
vectors, then twice as many each time, until no cell that is left can
improve the k-th best score.  So results are those of a full scan.  A round is one scan with
the wanted cells as partition filter; in it a cell's vectors meet the queries
that ask for the cell, by one product of matrices, and a task returns its k
best of each query.  ``probes`` stops after so many cells, for an approximate ranking.

Centres, bounds and which query wants which cell are on the driver and
broadcast: numbers of queries (4096 at most; beyond, a full scan is the better plan) times cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ranking import Best, top_k, vector_scores
from quillspark.scratch import materialize, scratch_path

MOST_QUERIES = 4096
MARGIN = 2e-6  # scores are compared after rounding to 6 digits


def fit_centres(sample: np.ndarray, n_cells: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds over a sample, from centres that are each farthest from those before; no more than it has different rows."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n_cells and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and how far it is."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
    near = d.argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


@dataclass(frozen=True)
class Visits:
    """What a ranking has read: for each query the cells visited and the vectors in them, of all."""

    qids: np.ndarray
    cells: np.ndarray
    vectors: np.ndarray
    total: int

    @property
    def share(self) -> float:
        """The share of (query, vector) pairs that were compared."""
        return float(self.vectors.sum() / max(1, len(self.qids) * self.total))


class CellIndex:
    """Vectors (key, embedding) stored by cells below ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root, key
        rows = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()  # n_cells rows
        self.ids = np.array([r.cell for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.radius, self.norm, self.count = (np.array([r[c] for r in rows], np.float64) for c in ("radius", "norm", "n"))

    @staticmethod
    def build(vectors: DataFrame, key: str, n_cells: int, root: str | None = None, per_cell: int = 64) -> CellIndex:
        spark = vectors.sparkSession
        root = root or scratch_path(spark, "cells")
        rows = vectors.where("embedding is not null").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
        sample = rows.orderBy(F.xxhash64(key), key).limit(n_cells * per_cell).collect()
        centres = fit_centres(np.array([r.embedding for r in sample], np.float64), n_cells) if sample else np.zeros((0, 1))
        handle = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix_of(b.column(1), b.num_rows)
                    cell, far = nearest(x, handle.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64()), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], names=[key, "embedding", "cell", "far", "norm"])

        placed = rows.mapInArrow(place, f"{key} long, embedding array<double>, cell long, far double, norm double")
        placed.repartitionByRange("cell", key).write.partitionBy("cell").parquet(f"{root}/vectors")
        stored = spark.read.schema(f"{key} long, embedding array<double>, far double, norm double, cell long").parquet(f"{root}/vectors")
        cells = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm"))
        table = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell long, centre array<double>")
        cells.join(F.broadcast(table), "cell").write.parquet(f"{root}/cells")
        return CellIndex(spark, root, key)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a product with each query can be in each cell."""
        size = np.sqrt((q * q).sum(1))[:, None]
        return np.minimum(q @ self.centres.T + size * self.radius, size * self.norm) + 1e-9

    def _scores(self, qids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """(qid, key, score): per task the ``k`` best of each query in the cells it wants."""
        key, some = self.key, wanted.any(0)
        asks = {int(c): np.flatnonzero(wanted[:, i]) for i, c in enumerate(self.ids) if some[i]}
        handle = self.spark.sparkContext.broadcast((qids, q, asks))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, asks = handle.value
            best = Best(k)
            for b in batches:
                if not b.num_rows:
                    continue
                keys, x, cell = b.column(0).to_numpy(), matrix_of(b.column(1), b.num_rows), b.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    mine, who = np.flatnonzero(cell == c), asks[c]
                    best.add(qids[who], keys[mine], np.round(x[mine] @ q[who].T, 6))
            yield from best.batches(key)

        rows = self.spark.read.schema(f"{key} long, embedding array<double>, cell long").parquet(f"{self.root}/vectors")
        return rows.where(F.col("cell").isin(sorted(asks))).mapInArrow(scan, f"qid long, {key} long, score double")

    def top_k(self, queries: DataFrame, k: int, probes: int | None = None) -> tuple[DataFrame, Visits | None]:
        """(qid, key, score, rnk) of queries (qid, embedding), and what was read; no visits where all was scanned."""
        asked = queries.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = asked.limit(MOST_QUERIES + 1).collect()
        if len(rows) > MOST_QUERIES or not rows or not len(self.ids):
            every = self.spark.read.schema(f"{self.key} long, embedding array<double>").parquet(f"{self.root}/vectors") if len(self.ids) else self.spark.createDataFrame([], f"{self.key} long, embedding array<double>")
            return top_k(vector_scores(every, asked, self.key, k), self.key, k), None
        qids, q = np.array([r.qid for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64)
        bound = self.bounds(q)
        order = np.argsort(-bound, 1, kind="stable")
        place = np.argsort(order, 1, kind="stable")  # of each cell in a query's order
        depth = 1 + (np.cumsum(self.count[order], 1) < k).sum(1)  # the first cells that hold k vectors together
        open_ = (place < (len(self.ids) if probes is None else probes)) & (bound > 0)
        visited, found, kth = np.zeros_like(open_), None, np.full(len(qids), -np.inf)
        row_of = {int(x): i for i, x in enumerate(qids)}
        while True:
            left = open_ & ~visited & (bound >= (kth - MARGIN)[:, None])
            if not left.any():
                break
            wanted = left & (place < depth[:, None])
            if wanted.any():
                new = self._scores(qids, q, wanted, k)
                found = materialize(top_k(new if found is None else new.unionByName(found.drop("rnk")), self.key, k), "best")
                full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
                for r in full.collect():  # a row a query
                    kth[row_of[r.qid]] = r.s
                visited |= wanted
            depth = 2 * depth
        visits = Visits(qids, visited.sum(1), (visited * self.count).sum(1), int(self.count.sum()))
        return (self.spark.createDataFrame([], f"qid long, {self.key} long, score double, rnk long") if found is None else found), visits

"""Centroid clustering of integer vectors with a LAESA pivot table.

The distance of every vector to a few fixed pivots is computed once and stored beside the vector.
Each round measures only the centroids against the pivots: by the triangle inequality the largest
difference of two pivot distances is a lower bound for vector and centroid. The centroid of the
least bound is measured first; those whose bound lies above its distance are out, the others get
exact integer distances. Rounds read the stored table once; a task sends counts and sums a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import slices, stage
from shiftgrain.llm.partials import matrix, total

PIVOTS = 8
#: Rows measured at a time in a task.
ROWS = 512
#: Largest absolute component: squared distances of 64 components then fit into a long.
EDGE = 1 << 27


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id long, v array<int>): floor(scale * x) of vectors with `dims` components, none null or non-finite.

    Repeated and null ids keep all their rows. Components beyond EDGE count as EDGE.
    """
    near = lambda x: F.greatest(F.lit(-float(EDGE)), F.least(F.lit(float(EDGE)), x * scale))
    return (
        rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .select("vec_id", F.transform("v", lambda x: F.floor(near(x)).cast("int")).alias("v"))
    )


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The `count` vectors of smallest sha256 of `seed:vec_id`, rows of null ids last, equal ids by vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r["v"] for r in vectors.orderBy(order, "v").limit(count).select("v").collect()], np.int64)


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots: from the first point on, each time the point farthest from all that are taken."""
    taken, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(count, len(points)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


def squared(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of `v` to every center."""
    return np.stack([((v - c) ** 2).sum(1) for c in centers], axis=1)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centers: np.ndarray, center_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest center of each row, ties to the smaller number; squared distance; exact distances computed)."""
    bound = np.zeros((len(v), len(centers)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - center_pivots[None, :, p]), out=bound)
    guess = bound.argmin(1)
    best = ((v - centers[guess]) ** 2).sum(1)
    alive = bound * (1 - 1e-9) - 1e-6 <= np.sqrt(best)[:, None]
    alive[np.arange(len(v)), guess] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(v)), guess] = best
    for c in range(len(centers)):
        rows = np.flatnonzero(alive[:, c])
        exact[rows, c] = ((v[rows] - centers[c]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[np.arange(len(v)), cluster], int(alive.sum()) + len(v)


class PivotTable:
    """Vectors with their distances to fixed pivots, as a written table."""

    def __init__(self, vectors: DataFrame, pivots: np.ndarray):
        self.pivots, self.dims = pivots, pivots.shape[1]
        dims = self.dims

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, ROWS * 8):
                far = np.sqrt(squared(matrix(batch.column("v"), dims).astype(np.int64), pivots))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "far"])

        self.table = stage(vectors.mapInArrow(measure, "vec_id long, v array<int>, far array<double>"))

    def _search(self, centers: np.ndarray):
        """A function of a batch: its vectors, their nearest centers and distances, slice by slice."""
        dims, width = self.dims, len(self.pivots)
        center_pivots = np.sqrt(squared(centers, self.pivots))

        def search(batch: pa.RecordBatch):
            for part in slices([batch], ROWS):
                v = matrix(part.column("v"), dims).astype(np.int64)
                yield part, v, *nearest(v, matrix(part.column("far"), width), centers, center_pivots)[:2]

        return search

    def updated(self, centers: np.ndarray) -> np.ndarray:
        """Centers after one round: floor of the mean of their vectors; empty ones stay."""
        search, dims = self._search(centers), self.dims

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(centers), dims + 1), np.int64)
            for _, v, cluster, _ in search(batch):
                for c in np.unique(cluster):
                    mine = cluster == c
                    out[c, :dims] += v[mine].sum(0)
                    out[c, dims] += mine.sum()
            return out.ravel()

        grid = total(self.table, sums, np.int64).reshape(len(centers), dims + 1)
        filled = grid[:, dims] > 0
        out = centers.copy()
        out[filled] = grid[filled, :dims] // grid[filled, dims:]
        return out

    def assigned(self, centers: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        search = self._search(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, cluster, far in search(batch):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"]
                    )

        return self.table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, id_col: str, vector_col: str, count: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row, final centroids).

    `rounds` times every vector goes to its nearest centroid and each non-empty centroid to the floor
    of the mean of its vectors; then vectors are assigned once more. Rows `kept_vectors` leaves out do
    not appear; fewer than `count` kept rows give as many centroids; none give no rows. Inertias are
    decimal(38, 0). The sums of a round are `count` x `dims` numbers a task.
    """
    vectors = kept_vectors(rows, id_col, vector_col, dims, scale)
    centers = first_centroids(vectors, count, seed)
    if not len(centers):
        none = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        zero = F.lit(0).cast("decimal(38,0)")
        return none.where("false").select("*", zero.alias("cluster_inertia"), zero.alias("inertia"), F.lit("").alias("centroid_sha256")), centers
    table = PivotTable(vectors, far_apart(centers, PIVOTS))
    for _ in range(rounds):
        centers = table.updated(centers)
    found = stage(table.assigned(centers))
    spent = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    names = rows.sparkSession.createDataFrame(
        [(c, s, digests[c]) for c, s in spent.items()], "cluster int, cluster_inertia decimal(38,0), centroid_sha256 string"
    )
    out = found.join(F.broadcast(names), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(spent.values())).cast("decimal(38,0)").alias("inertia"), "centroid_sha256"), centers

"""Ball k-means over integer vectors: exact Lloyd rounds that compare few centroids.

A cluster is a ball: its centroid and the largest distance of a member. Another centroid can only matter to a ball if half
the way to it is no longer than the radius; those are the ball's neighbours. A member nearer to its centroid than half the way to the nearest neighbour is in the stable
core and is not compared at all. The others lie in annuli between the half ways to one neighbour and the next and are compared with the
neighbours inside of theirs only. All of this is integer arithmetic on squared distances, so ties and sums are exact: a centroid with
C > 4 D (C between centroids, D of the member, both squared) is strictly farther away.

Every round is one pass that reads the vectors with their clusters, assigns them anew and writes them. Each task adds its sums, counts and
inertia for every cluster to what it writes, so the next centroids come from k rows for each task, summed by Spark. The driver holds k centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depframe.session import discard, materialise

#: Vectors beyond this magnitude could pass 64 bits in a squared distance of up to ``MOST_DIMENSIONS`` components.
LIMIT, MOST_DIMENSIONS = 1 << 26, 1 << 8
#: Up to here all products and sums are whole numbers of doubles, so the fast matrix product is exact.
EXACT = 1 << 20
#: Most clusters: their centroids and sums go through the driver.
MOST_CLUSTERS = 10_000
_STATE = "vec_id {id}, v array<int>, cluster int, distance long, part int, n long, sums array<long>, radius long, inertia long"


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = vectors - centre
    return np.einsum("ij,ij->i", d, d)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([squared(vectors, c) for c in centroids], axis=1)


class Balls:
    """Centroids and for each its neighbours by distance; ``radius`` (squared) of each ball, where one is known, leaves far ones out."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray | None = None):
        self.centroids = centroids
        between = distances(centroids, centroids)
        np.fill_diagonal(between, -1)
        self.order = [np.argsort(row, kind="stable")[1:] for row in between]
        self.between = [row[o] for row, o in zip(between, self.order, strict=True)]
        if radius is not None:
            for i, r in enumerate(radius):
                near = int(np.searchsorted(self.between[i], 4 * int(r), side="right"))
                self.order[i], self.between[i] = self.order[i][:near], self.between[i][:near]

    def assign(self, vectors: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector; of equally near centroids the smaller number. ``last`` has each one's cluster so far."""
        if last is None:
            every = distances(vectors, self.centroids)
            cluster = every.argmin(axis=1)
            return cluster.astype(np.int32), every[np.arange(len(vectors)), cluster]
        cluster, best = last.astype(np.int32), np.zeros(len(vectors), np.int64)
        for i in np.unique(last):
            rows = np.flatnonzero(last == i)
            best[rows] = own = squared(vectors[rows], self.centroids[i])
            ring = np.searchsorted(self.between[i], 4 * own, side="right")  # neighbours that are not strictly farther; 0: stable core
            by_ring = np.argsort(-ring, kind="stable")
            rows, ring = rows[by_ring], ring[by_ring]
            for k, j in enumerate(self.order[i]):
                rows = rows[: int(np.searchsorted(-ring, -k, side="left"))]  # rings beyond k
                if not len(rows):
                    break
                ring = ring[: len(rows)]
                d = squared(vectors[rows], self.centroids[j])
                nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
                best[rows[nearer]], cluster[rows[nearer]] = d[nearer], j
        return cluster, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _round(centroids: np.ndarray, radius: np.ndarray | None, moved: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns every vector anew; at last one row for each cluster with what this task's vectors add to it.

    ``moved`` is how far each centroid went (squared, rounded up), which with the old radius bounds the new ball.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        bound = None
        if radius is not None:  # (sqrt(r) + sqrt(m))^2 <= 2 r + 2 m
            bound = np.minimum(2 * radius + 2 * moved, np.iinfo(np.int64).max >> 3)
        balls = Balls(centroids, bound)
        n, sums, far, inertia = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if not len(batch):
                continue
            vectors = _matrix(batch.column(1), width)
            last = None if radius is None else batch.column(2).to_numpy(zero_copy_only=False)
            cluster, distance = balls.assign(vectors, last)
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order], starts, axis=0)
            far[found] = np.maximum(far[found], np.maximum.reduceat(distance[order], starts))
            inertia[found] += np.add.reduceat(distance[order], starts)
            blank = lambda t: pa.nulls(len(batch), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance), blank(pa.int32()), blank(pa.int64()), blank(pa.list_(pa.int64())), blank(pa.int64()), blank(pa.int64())],
                names=["vec_id", "v", "cluster", "distance", "part", "n", "sums", "radius", "inertia"],
            )
        if kind is not None:
            used = np.flatnonzero(n)
            blank = lambda t: pa.nulls(len(used), t)
            yield pa.RecordBatch.from_arrays(
                [blank(kind), blank(pa.list_(pa.int32())), blank(pa.int32()), blank(pa.int64()), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array(far[used]), pa.array(inertia[used])],
                names=["vec_id", "v", "cluster", "distance", "part", "n", "sums", "radius", "inertia"],
            )

    return run


def _summed(state: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]], list[int], list[int]]:
    """Count, component sums, largest distance and inertia of each cluster: k rows that Spark has summed over all tasks."""
    parts = state.where("part is not null")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    totals = parts.groupBy("part").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), exact(F.col("inertia")).alias("inertia"))
    by_place = parts.select("part", F.posexplode("sums").alias("d", "x")).groupBy("part", "d").agg(exact(F.col("x")).alias("x"))
    n, sums, radius, inertia = [0] * k, [[0] * width for _ in range(k)], [0] * k, [0] * k
    for r in totals.collect():
        n[r["part"]], radius[r["part"]], inertia[r["part"]] = r["n"], r["radius"], int(r["inertia"])
    for r in by_place.collect():
        sums[r["part"]][r["d"]] = int(r["x"])
    return n, sums, radius, inertia


def integer_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of ``width`` components, none null or not finite, each as floor(scale * x)."""
    x = F.col(f"`{vector}`")
    whole = (F.size(x) == width) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # Under ANSI casts a component beyond an int is an error, which is wanted: it is never cut off.
    kept = df.where(F.coalesce(whole, F.lit(False)))
    return kept.select(F.col(f"`{key}`").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int")).alias("v"))


def ball_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors with another number of components than ``width``, or with a null or non-finite one, are left out, as are null vectors. Each component x counts as
    floor(scale * x). Centroids begin as the k vectors of least sha256 of ``seed:key`` (a null key: ``seed:``); of rows with one key the least vector comes first. Repeated rows
    count as often as they occur. With fewer than k vectors there are as many clusters; an empty table gives an empty one. Components of a
    magnitude over 2^26 after scaling are an error: their squared distances could pass 64 bits.
    """
    if k > MOST_CLUSTERS or width > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_CLUSTERS} clusters of {MOST_DIMENSIONS} components")
    spark = df.sparkSession
    vectors = materialise(integer_vectors(df, key, vector, width, scale), "vectors")
    widest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v").cast("long")))).first()[0]
    if widest is not None and widest > LIMIT:
        raise ArithmeticError(f"a component of {widest} is over {LIMIT}")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    centroids = np.array(first, np.int64).reshape(len(first), width)
    schema = _STATE.format(id=vectors.schema["vec_id"].dataType.simpleString())
    state, radius, moved = vectors, None, None
    for step in range(rounds + 1):
        if not len(centroids):
            break
        read = state if radius is None else state.where("part is null")
        now = materialise(read.select("vec_id", "v", *(["cluster"] if radius is not None else [])).mapInArrow(_round(centroids, radius, moved), schema), "balls")
        discard(state)
        state = now
        n, sums, far, inertia = _summed(state, len(centroids), width)
        if step < rounds:
            new = np.array([[x // n[i] for x in sums[i]] if n[i] else centroids[i].tolist() for i in range(len(centroids))], np.int64)
            radius, moved, centroids = np.array(far, np.int64), squared(new, centroids), new
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    told = [(i, inertia[i], sum(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.where("part is null").select("vec_id", "cluster", "distance")
    return rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows

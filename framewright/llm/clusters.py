"""Centroid clustering with exponion search: each vector scans only the centroids in a ball around its own.

Vectors become integers and are packed into blocks of bounded bytes. A block also carries each vector's
centroid, an upper bound of its distance and a lower bound of its distance to every other
centroid. Between rounds the bounds widen by how far centroids moved. A vector whose bounds
don't touch keeps its centroid unseen; otherwise its distance is computed, and if that doesn't settle it, it looks at the
centroids within 2 u + s of its own, u being its distance and s that to the centroid's nearest
neighbour: for each centroid the others stand sorted by distance, so the ball is the front of a list. The radius is
inclusive and distances are compared in whole numbers, so ties go to the lower number.

Every round writes the blocks with their bounds, and the sums of each block's clusters beside them; the next centroids are
sums of those, so no vector leaves its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import saved
from framewright.llm.vectors import finite, matrix, whole

#: Bytes of the vectors in a block (as 32-bit numbers).
BLOCK_BYTES = 1 << 20
#: By so much float bounds are widened, as a share: more than their rounding.
SLACK = 1e-12

_BLOCK = "ids array<bigint>, points binary, cluster binary, upper binary, lower binary, sums array<bigint>"


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, components: int = 64, prefix: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector, and the centroids (k, components); distance is squared.

    Kept are vectors with exactly so many components, none of them null or non-finite; a component counts as floor(scale * x).
    Centroids start as the k vectors (fewer, if there are fewer) of least SHA-256 of prefix and decimal id, of equal
    ones the least vector, so rows that repeat an id or a vector may start several; null ids don't start any while there are others. Ties go to the lower number. Rows with
    null ids are clustered like others, an empty table gives no rows and no centroids. Columns other than the two don't
    matter. Components so large that squared distances leave 64 bits are an error.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw")).filter(finite(F.col("raw")) & (F.size("raw") == components))
    plain = plain.select("vec_id", whole(F.col("raw"), scale).alias("v"))
    order = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    start = plain.orderBy(F.asc_nulls_last(order), "v").select("v").limit(k).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, components)
    blocks = saved(_packed(plain, components), "blocks")
    if not start:
        return _rows(blocks, centroids), centroids
    moved = None
    for _ in range(rounds):
        blocks = saved(_assigned(blocks, centroids, moved), "clusters")
        new = _centroids(blocks, centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1)) * (1 + SLACK)
        centroids = new
    return _rows(_assigned(blocks, centroids, moved), centroids), centroids


def _packed(vectors: DataFrame, components: int) -> DataFrame:
    """Every partition's vectors in blocks, without clusters so far."""
    most = max(1, BLOCK_BYTES // (4 * max(components, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                points = matrix(part.column(1), components).astype(np.int32)
                yield _block(part.column(0), points, np.full(part.num_rows, -1, np.int32), np.zeros(part.num_rows), np.zeros(part.num_rows), 0)

    return vectors.select("vec_id", "v").mapInArrow(run, _BLOCK)


def _block(ids: pa.Array, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> pa.RecordBatch:
    """A block with the sums of its clusters: of each one its components', then its number of vectors."""
    sums = np.zeros((k, points.shape[1] + 1), np.int64)
    if k:
        order = np.argsort(cluster, kind="stable")
        seen, at = np.unique(cluster[order], return_index=True)
        sums[seen, :-1] = np.add.reduceat(points[order].astype(np.int64), at, axis=0)
        sums[seen, -1] = np.diff(np.append(at, len(order)))
    blobs = (pa.array([x.tobytes()], pa.binary()) for x in (points, cluster.astype(np.int32), upper, lower))
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *blobs, pa.array([sums.ravel()], pa.list_(pa.int64()))], ["ids", "points", "cluster", "upper", "lower", "sums"])


def _assigned(blocks: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Blocks with every vector at its nearest centroid. moved: how far each centroid went since the last time; none before the first."""
    k, components = centroids.shape
    known = near(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points, cluster, upper, lower = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in ((1, np.int32), (2, np.int32), (3, np.float64), (4, np.float64)))
                points = points.reshape(len(cluster), components)
                if moved is None:
                    cluster, upper, lower = first_found(points, centroids)
                else:
                    cluster, upper, lower, _ = found(points, centroids, known, cluster, *drifted(cluster, upper, lower, moved))
                yield _block(batch.column(0)[row].values, points, cluster, upper, lower, k)

    return blocks.mapInArrow(run, _BLOCK)


def near(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid the others' numbers by distance, and those distances."""
    away = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(np.float64))
    np.fill_diagonal(away, -1)
    order = away.argsort(axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(away, order, axis=1)


def drifted(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after centroids moved: up by the own centroid's way, down by the longest of the others'."""
    far = moved.argmax()
    others = np.where(np.arange(len(moved)) == far, np.delete(moved, far).max(initial=0), moved[far])
    return (upper + moved[cluster]) * (1 + SLACK), (lower - others[cluster]) * (1 - SLACK) - SLACK


def first_found(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of every point by looking at all, its distance, and that of the next."""
    best, cluster = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int32)
    second = best.copy()
    for c, centre in enumerate(centroids):
        away = ((points - centre) ** 2).sum(axis=1)
        nearer = away < best
        second = np.where(nearer, best, np.minimum(second, away))
        best[nearer], cluster[nearer] = away[nearer], c
    return cluster, np.sqrt(best) * (1 + SLACK), _root(second) * (1 - SLACK)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.where(squared == np.iinfo(np.int64).max, np.inf, np.sqrt(squared.astype(np.float64)))


def found(points: np.ndarray, centroids: np.ndarray, known: tuple[np.ndarray, np.ndarray], cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids, bounds of the distances to them and to the next ones, and how many distances that took."""
    order, away = known
    k = len(centroids)
    gap = away[:, 0] * (1 - SLACK) if k > 1 else np.full(1, np.inf)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    safe = np.maximum(lower, gap[cluster] / 2)
    loose = np.nonzero(upper >= safe)[0]
    own = ((points[loose] - centroids[cluster[loose]]) ** 2).sum(axis=1)
    taken = len(loose)
    upper[loose] = np.sqrt(own) * (1 + SLACK)
    still = upper[loose] >= safe[loose]
    loose, best = loose[still], own[still]
    before = cluster[loose]
    radius = (2 * upper[loose] + (away[before, 0] if k > 1 else 0)) * (1 + SLACK)
    for c in np.unique(before):
        mine = np.nonzero(before == c)[0]
        within = np.searchsorted(away[c], radius[mine], side="right")
        mine = mine[np.argsort(-within, kind="stable")]
        within = -np.sort(-within)
        least, number = best[mine].copy(), np.full(len(mine), c, np.int32)
        second = np.full(len(mine), np.iinfo(np.int64).max)
        for place in range(int(within.max(initial=0))):
            n = int(np.searchsorted(-within, -place, side="left"))  # so many balls reach beyond this place
            other = order[c, place]
            distance = ((points[loose[mine[:n]]] - centroids[other]) ** 2).sum(axis=1)
            taken += n
            nearer = (distance < least[:n]) | ((distance == least[:n]) & (other < number[:n]))
            second[:n] = np.where(nearer, least[:n], np.minimum(second[:n], distance))
            least[:n], number[:n] = np.where(nearer, distance, least[:n]), np.where(nearer, other, number[:n])
        at = loose[mine]
        cluster[at], upper[at], lower[at] = number, np.sqrt(least) * (1 + SLACK), _root(second) * (1 - SLACK)
    return cluster, upper, lower, taken


def _centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid as the floor of its vectors' mean; without vectors it stays."""
    summed = blocks.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # as many rows as the centroids have numbers
    total = np.zeros(len(centroids) * (centroids.shape[1] + 1), np.int64)
    total[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    total = total.reshape(len(centroids), -1)
    counts = total[:, -1:]
    return np.where(counts > 0, total[:, :-1] // np.maximum(counts, 1), centroids)


def _rows(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cluster = np.frombuffer(batch.column(2)[row].as_buffer(), np.int32)
                points = np.frombuffer(batch.column(1)[row].as_buffer(), np.int32).reshape(len(cluster), -1)
                distance = ((points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "points", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia and inertia, distance summed over a vector's cluster and over all, and centroid_sha256, of the centroid's components as decimal numbers joined by commas."""
    found = saved(found, "found")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    kept = found.sparkSession.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(kept), "cluster")  # k rows, a parameter

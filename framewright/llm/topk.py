"""Exact top-k inner products: vectors by falling length, partial sums in rotated coordinates, bounds by Cauchy-Schwarz.

Vectors become integers and are written once, dealt and sorted by falling length, with a table's worth of
rows in every task. The second moments of all of them, summed by Spark, give the rotation of their singular vectors: after it the
first few coordinates hold most of every length. Queries come in blocks of bounded bytes; a block is
broadcast and every task scans its vectors against it, longest first:

* a query whose k-th best score is beyond |q| |x| of the longest vector of a stretch is left out, of later stretches too as a rule, since lengths fall;
* what is left is bounded by the partial sum over the first rotated coordinates plus the product of
  both residual lengths;
* what passes is scored exactly, in integers.

Float bounds carry a margin above their rounding, and only what is strictly below a k-th best score is
left out, so ties are settled by id alone. A task keeps k rows a query at most; the k best of all tasks are taken by one shuffle of those rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import saved, shared_dir
from framewright.llm.vectors import finite, matrix, whole

#: Bytes of the queries that are broadcast together, of vectors in a task, and numbers of a task's table of bounds.
QUERY_BYTES, TASK_BYTES, BOUNDS = 8 << 20, 32 << 20, 1 << 22
#: Longest vectors that give every query its first k-th best score.
SEEDS = 1024
#: Share of the squared lengths that the first rotated coordinates hold. Above so many components nothing is rotated, as a rotation has their square.
ENERGY, ROTATED = 0.7, 2048
#: Margin of a float bound, as a share of |q| |x|.
MARGIN = 1e-9

_LEAST = np.iinfo(np.int64).min
_FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which `is_query`, the k other rows of largest inner product.

    Components count as floor(scale * x). Vectors that are null or hold null or non-finite components take no part; shorter
    ones count as followed by zeros, so an empty vector scores 0 with all. Ties go to the smaller id, a null id
    comes last. Each row is a candidate but for itself: rows that repeat an id or a vector count as often as they are there, and queries
    that repeat an id each have their own ranks. Fewer than k candidates give fewer rows, an empty table none.
    Columns other than the two don't matter. Components so large that scores leave 64 bits are an error.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("raw")).filter(finite(F.col("raw")))
    plain = saved(plain.select("vec_id", "asks", whole(F.col("raw"), scale).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, components, asked = plain.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if("asks")).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    parts = max(1, math.ceil(n * max(components, 1) * 8 / TASK_BYTES), min(spark.sparkContext.defaultParallelism, n // SEEDS))
    # rows of equal length are dealt by a hash, so many copies of one vector don't meet in one task
    order = [F.desc("length"), F.xxhash64("row")]
    sorted_ = saved(plain.withColumn("length", length).repartitionByRange(parts, *order).sortWithinPartitions(*order), "sorted")
    rotation, first = _rotation(sorted_, components)
    seeds = _arrays(sorted_.orderBy(*order).limit(SEEDS), components)
    blocks = max(1, math.ceil(asked * max(components, 1) * 8 / QUERY_BYTES))
    asking = saved(sorted_.filter("asks").select("row", "vec_id", "v", "length").repartition(blocks).withColumn("block", F.spark_partition_id()), "queries")
    path = f"{shared_dir(spark).rstrip('/')}/framewright/{uuid.uuid4().hex}/found"
    for block in range(blocks):
        one = _arrays(asking.filter(F.col("block") == block), components)
        if len(one["row"]):
            _scan(sorted_, one, seeds, rotation, first, k).write.option("compression", "zstd").parquet(f"{path}/block={block}")
    found = spark.read.schema(_FOUND).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrays(df: DataFrame, components: int) -> dict[str, np.ndarray]:
    """A bounded number of vectors as arrays on the driver."""
    found = df.select("row", "vec_id", "v", "length").toArrow().combine_chunks()
    v = found.column("v").combine_chunks()
    return {"row": found.column("row").to_numpy(), "length": found.column("length").to_numpy(), "v": matrix(v, components), "id": found.column("vec_id").fill_null(0).to_numpy(), "no_id": found.column("vec_id").is_null().to_numpy()}


def _rotation(vectors: DataFrame, components: int) -> tuple[np.ndarray, int]:
    """Singular vectors of all vectors as columns, strongest first, and how many hold ENERGY of the squared lengths.

    Each task sums the products of its vectors' components (components squared numbers), Spark adds them up.
    """
    if not 0 < components <= ROTATED:
        return np.eye(components), max(1, components // 2)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for batch in batches:
            v = matrix(batch.column(0), components).astype(np.float64)
            total += v.T @ v
        place = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])

    summed = vectors.select("v").mapInArrow(products, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    moments = np.zeros(components * components)
    moments[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    energy, rotation = np.linalg.eigh(moments.reshape(components, components))
    share = np.cumsum(np.maximum(energy[::-1], 0))
    first = int(np.searchsorted(share, ENERGY * share[-1])) + 1
    return np.ascontiguousarray(rotation[:, ::-1]), min(first, components)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b: as floats where those hold every sum exactly."""
    top = [max(-int(x.min()), int(x.max())) if x.size else 0 for x in (a, b)]
    if a.shape[1] * top[0] * top[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _first_limits(queries: dict, seeds: dict, k: int) -> np.ndarray:
    """A score that k candidates of each query reach, by the seeds; the least number where there are fewer."""
    out = np.full(len(queries["row"]), _LEAST)
    if len(seeds["row"]) > k:
        step = max(1, BOUNDS // len(seeds["row"]))
        for at in range(0, len(out), step):
            scores = _products(queries["v"][at : at + step], seeds["v"])
            scores[queries["row"][at : at + step, None] == seeds["row"][None]] = _LEAST
            out[at : at + step] = np.partition(scores, -k, axis=1)[:, -k]
    return out


class _Best:
    """The k best of every query so far, and the score that a candidate must reach."""

    def __init__(self, queries: int, k: int, limits: np.ndarray) -> None:
        self.k, self.limits = k, limits.copy()
        self.score, self.id, self.no_id = np.full((queries, k), _LEAST), np.zeros((queries, k), np.int64), np.zeros((queries, k), bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        touched = np.unique(query)
        held = self.score[touched].ravel() != _LEAST
        query = np.concatenate([np.repeat(touched, self.k)[held], query])
        score = np.concatenate([self.score[touched].ravel()[held], score])
        ids = np.concatenate([self.id[touched].ravel()[held], ids])
        no_id = np.concatenate([self.no_id[touched].ravel()[held], no_id])
        order = np.lexsort((ids, no_id, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        for kept, new in ((self.score, score), (self.id, ids), (self.no_id, no_id)):
            kept[query, place] = new[order]
        self.limits[touched] = np.maximum(self.limits[touched], self.score[touched, -1])


def _scan(vectors: DataFrame, queries: dict, seeds: dict, rotation: np.ndarray, first: int, k: int) -> DataFrame:
    """The k best of every query of one block in each task's vectors, as far as they can be among the k best of all."""
    limits = _first_limits(queries, seeds, k)
    rotated = queries["v"] @ rotation
    known = vectors.sparkSession.sparkContext.broadcast(queries | {"head": rotated[:, :first].copy(), "rest": np.linalg.norm(rotated[:, first:], axis=1), "limits": limits, "rotation": rotation})
    components = rotation.shape[0]
    needed = np.where(limits > 0, limits / np.maximum(queries["length"], 1.0), 0.0).min() * (1 - MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = known.value
        best = _Best(len(q["row"]), k, q["limits"])
        step = max(16, BOUNDS // len(q["row"]))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                _compare(q, best, batch.slice(at, step), components, first)
        query, place = np.nonzero(best.score > _LEAST)
        ids = pa.array(best.id[query, place], mask=best.no_id[query, place])
        askers = pa.array(q["id"][query], mask=q["no_id"][query])
        yield pa.RecordBatch.from_arrays([pa.array(q["row"][query]), askers, ids, pa.array(best.score[query, place])], ["query_row", "query_id", "vec_id", "score"])

    # sorted files: vectors too short for every query are passed over by their statistics
    return vectors.filter(F.col("length") >= float(needed)).select("row", "vec_id", "v", "length").mapInArrow(run, _FOUND)


def _compare(q: dict, best: _Best, part: pa.RecordBatch, components: int, first: int) -> None:
    """Hold some vectors against the queries that the longest of them can still reach."""
    length = part.column(3).to_numpy()
    alive = np.nonzero(q["length"] * length.max() * (1 + MARGIN) >= best.limits)[0]
    if not len(alive):
        return
    v, rows = matrix(part.column(2), components), part.column(0).to_numpy()
    rotated = v @ q["rotation"]
    bound = q["head"][alive] @ rotated[:, :first].T
    bound += q["rest"][alive, None] * np.linalg.norm(rotated[:, first:], axis=1)
    bound += MARGIN * q["length"][alive, None] * length
    query, place = np.nonzero(bound >= best.limits[alive, None])
    if 4 * len(query) > bound.size:
        score = _products(q["v"][alive], v)[query, place]
    else:
        score = np.concatenate([np.einsum("ij,ij->i", q["v"][alive[query[i : i + 65536]]], v[place[i : i + 65536]]) for i in range(0, len(query), 65536)] or [np.zeros(0, np.int64)])
    query = alive[query]
    kept = (score >= best.limits[query]) & (q["row"][query] != rows[place])
    if kept.any():
        query, place, score = query[kept], place[kept], score[kept]
        ids = part.column(1)
        best.add(query, score, ids.fill_null(0).to_numpy(zero_copy_only=False)[place], ids.is_null().to_numpy(zero_copy_only=False)[place])

"""Product codes of integer vectors: codebooks by Lloyd's rounds with filtering over kd-trees.

Every partition cuts its vectors into blocks of bounded bytes and builds one kd-tree over each part position
of a block, once: a balanced tree whose nodes hold the bounding box, the sum and the number of their
points. The trees are written to the shared folder and every round reads them again. A round walks a
tree level by level with the entries that a box may still be nearest to; an entry goes when another
one is nearer to the whole box, and a node with one entry left adds its cached sum and number at once. Only leaves with several entries left
compare points. Partitions give back sums of entries, never points. Everything is exact in
integers, ties included.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import saved
from framewright.llm.vectors import finite, matrix, whole

#: Bytes of the vectors in a block (as 32-bit numbers), and points of a leaf.
BLOCK_BYTES, LEAF = 1 << 20, 16
#: Sums of so many labels are broadcast; of more they are joined by a shuffle, with hot labels split by SALTS.
FEW_LABELS, SALTS = 10_000, 32


@dataclass
class Tree:
    """A balanced kd-tree: level by level the boxes, sums and numbers of all nodes, and the points of the leaves in order.

    slots has each leaf place's row in the block; places beyond the block's rows repeat its last point and count for nothing.
    """

    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    slots: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.counts) + 1).bit_length() - 2


def grown(points: np.ndarray) -> Tree:
    """A tree over points (n, d), split at the middle of the widest side down to LEAF points."""
    n, d = points.shape
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    slots = np.arange(LEAF << depth)[None]
    low, high, sums, counts = [], [], [], []
    for level in range(depth + 1):
        held = points[np.minimum(slots, n - 1)]
        real = slots < n
        low.append(held.min(axis=1))
        high.append(held.max(axis=1))
        sums.append((held * real[..., None]).sum(axis=1))
        counts.append(real.sum(axis=1))
        if level < depth:
            widest = (high[-1] - low[-1]).argmax(axis=1) if d else np.zeros(len(slots), np.int64)
            key = np.take_along_axis(held, widest[:, None, None], axis=2)[..., 0] if d else slots
            half = slots.shape[1] // 2
            slots = np.take_along_axis(slots, np.argpartition(key, half, axis=1), axis=1).reshape(-1, half)
    return Tree(np.concatenate(low), np.concatenate(high), np.concatenate(sums), np.concatenate(counts), slots.ravel())


def filtered(tree: Tree, points: np.ndarray, entries: np.ndarray, rows: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and numbers of the points nearest to each entry (k, d), ties to the lower one; with `rows` also every point's entry."""
    n, d = points.shape
    k = len(entries)
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    chosen = np.zeros(len(tree.slots), np.int64) if rows else None
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(tree.depth + 1):
        at = (1 << level) - 1 + nodes
        low, high = tree.low[at].astype(np.int64), tree.high[at].astype(np.int64)
        left = left & ~_beaten(left, low, high, entries)
        one = left.sum(axis=1) == 1
        winner = left[one].argmax(axis=1)
        np.add.at(sums, winner, tree.sums[at[one]])
        np.add.at(counts, winner, tree.counts[at[one]])
        if rows:
            size = len(tree.slots) >> level
            chosen.reshape(-1, size)[nodes[one]] = winner[:, None]
        nodes, left = nodes[~one], left[~one]
        if not len(nodes):
            break
        if level < tree.depth:
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), left.repeat(2, axis=0)
    else:
        slots = tree.slots.reshape(-1, LEAF)[nodes]
        real = slots < n
        held = points[np.minimum(slots, n - 1)].astype(np.int64)
        nearest = np.zeros(slots.shape, np.int64)
        best = np.full(slots.shape, np.iinfo(np.int64).max)
        for e in range(k):
            away = ((held - entries[e]) ** 2).sum(axis=2)
            nearer = left[:, e, None] & (away < best)
            best[nearer], nearest[nearer] = away[nearer], e
        np.add.at(sums, nearest[real], held[real])
        np.add.at(counts, nearest[real], 1)
        if rows:
            chosen.reshape(-1, LEAF)[nodes] = nearest
    if not rows:
        return sums, counts, None
    out = np.zeros(n, np.int64)
    out[tree.slots[tree.slots < n]] = chosen[tree.slots < n]
    return sums, counts, out


def _beaten(left: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries another one, the nearest to the box's middle, beats for every point of the box (m, d).

    It does so if it does at the box's corner that lies furthest towards the other entry; on equal distances there only if its number is lower.
    """
    middle = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
    middle[~left] = np.iinfo(np.int64).max
    star = middle.argmin(axis=1)
    first = entries[star][:, None]
    corner = np.where(entries[None] > first, high[:, None], low[:, None])
    more = ((entries[None] - corner) ** 2 - (first - corner) ** 2).sum(axis=2)
    return (more > 0) | ((more == 0) & (np.arange(len(entries)) > star[:, None]))


_BLOCK = "ids array<bigint>, points binary, low binary, high binary, sums binary, counts binary, slots binary"


def _blocks(vectors: DataFrame, components: int, parts: int) -> DataFrame:
    """Rows (ids, labels, points and the trees of all part positions) of every partition's blocks, from (vec_id, label, v)."""
    from pyspark.sql.pandas.types import to_arrow_type

    most = max(LEAF, BLOCK_BYTES // (4 * max(components, 1)))
    kind = to_arrow_type(vectors.schema["label"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and sum(b.num_rows for b in held) + part.num_rows > most:
                    yield block(held)
                    held = []
                held.append(part)
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        points = matrix(rows.column(2), components).astype(np.int32)
        trees = [grown(p) for p in np.split(points, parts, axis=1)]
        sizes = {"low": np.int32, "high": np.int32, "sums": np.int64, "counts": np.int32, "slots": np.int32}
        blobs = [np.stack([getattr(t, name) for t in trees]).astype(size).tobytes() for name, size in sizes.items()]
        cells = [pa.array([rows.column(0)], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in (points.tobytes(), *blobs)), pa.array([rows.column(1)], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(cells, ["ids", "points", "low", "high", "sums", "counts", "slots", "labels"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"{_BLOCK}, labels array<{vectors.schema['label'].dataType.simpleString()}>")


def _unpacked(batch: pa.RecordBatch, row: int, components: int, parts: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The tree and the points of each part position of a block."""
    cell = lambda name, size: np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), size)
    wide = components // parts
    points = cell("points", np.int32).reshape(-1, parts, wide)
    counts, slots = cell("counts", np.int32).reshape(parts, -1), cell("slots", np.int32).reshape(parts, -1)
    low, high, sums = (cell(name, size).reshape(parts, counts.shape[1], wide) for name, size in (("low", np.int32), ("high", np.int32), ("sums", np.int64)))
    for p in range(parts):
        yield Tree(low[p], high[p], sums[p], counts[p], slots[p]), points[:, p]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, k, d) after one round; entries without a part stay."""
    parts, k, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, wide + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, (tree, points) in enumerate(_unpacked(batch, row, parts * wide, parts)):
                    sums, counts, _ = filtered(tree, points, books[p])
                    total[p] += np.concatenate([sums, counts[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["place", "value"])

    needed = blocks.select("points", "low", "high", "sums", "counts", "slots")
    summed = needed.mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # as many rows as the codebooks have numbers
    total = np.zeros(parts * k * (wide + 1), np.int64)
    total[summed.column("place").to_numpy()] = summed.column("value").to_numpy()
    total = total.reshape(parts, k, wide + 1)
    counts = total[..., -1:]
    return np.where(counts > 0, total[..., :-1] // np.maximum(counts, 1), books)


def _first_rows(vectors: DataFrame, most: int) -> list[list[int]]:
    """The vectors of the `most` smallest ids; of rows that repeat an id the least vector."""
    ids: list[int] = []
    while len(ids) < most:
        more = vectors.filter(F.col("vec_id") > ids[-1]) if ids else vectors.filter("vec_id IS NOT NULL")
        found = more.select("vec_id").orderBy("vec_id").limit(most).collect()
        if not found:
            break
        ids = sorted({*ids, *(r.vec_id for r in found)})[:most]
    least = vectors.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v"))
    return [r.v for r in least.orderBy("vec_id").collect()]


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes array<int>, error) of every vector, and the codebooks (parts, entries, components of a part).

    Components count as floor(scale * x). Vectors that are null or hold null or non-finite components are left out, and so are those
    of another length than the vector of the smallest id whose length is a positive multiple of `parts`: they have
    no equal parts or no entry to be held against. Codebooks start as the parts of the `entries` smallest ids (fewer, if there are
    fewer ids; of rows that repeat an id the least vector); null ids don't start any. Ties go to the lower entry.
    Repeated rows and null ids are coded like any other, and an empty table gives no rows and codebooks without entries. Columns
    other than the three don't matter. Components so large that squared distances leave 64 bits are an error.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("raw")).filter(finite(F.col("raw")))
    plain = plain.select("vec_id", "label", whole(F.col("raw"), scale).alias("v")).filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    lead = plain.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    components = lead.n if lead else parts
    plain = plain.filter(F.size("v") == components)
    start = np.array(_first_rows(plain, entries), np.int64).reshape(-1, components)
    if lead and not len(start):  # ids are all null
        start = np.array([plain.agg(F.min("v")).first()[0]], np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = saved(_blocks(plain, components, parts), "trees")
    for _ in range(rounds if lead else 0):
        books = _round(blocks, books)
    return _coded(blocks, books), books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """Every vector's entries and its squared distance from them."""
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                code, error = [], 0
                for p, (tree, points) in enumerate(_unpacked(batch, row, parts * wide, parts)):
                    chosen = filtered(tree, points, books[p], rows=True)[2]
                    code.append(chosen)
                    error = error + ((points - books[p][chosen]) ** 2).sum(axis=1)
                flat = np.stack(code, axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * parts), pa.array(flat.ravel()))
                ids, labels = (batch.column(batch.schema.get_field_index(n))[row].values for n in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(np.asarray(error, np.int64))], ["vec_id", "label", "codes", "error"])

    kind = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")


def code_text(chosen: Column) -> Column:
    """Entries in part order, each as two hex digits (more where an entry's number needs them), lowercase."""
    return F.array_join(F.transform(chosen, lambda c: F.lower(F.when(c < 256, F.lpad(F.hex(c), 2, "0")).otherwise(F.hex(c)))), "")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the sum of `error` over rows of an equal label, null labels together.

    Labels' sums are pre-aggregated. Few of them are broadcast, after a count; with more, each label's rows are dealt by a salt.
    """
    coded = saved(coded, "codes")
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    if sums.count() <= FEW_LABELS:
        other = F.broadcast(sums.withColumnRenamed("label", "_label"))
        return coded.join(other, coded["label"].eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "_label")
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")), "left").drop("_label", "_salt", "_own")

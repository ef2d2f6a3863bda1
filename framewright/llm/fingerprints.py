"""Order MinHash fingerprints: signatures of texts that are sensitive to edit distance.

A text's k-mers are numbered by occurrence, so repeats are different items. Items fall into buckets by
hash; of each bucket the `tuple_size` items of least hash are kept in text order, and the hash of
that tuple is the bucket's value. Likeness is the share of equal values among buckets that either has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import mix64, saved, sliced, texts_of

#: Code points of a k-mer, buckets of a signature (a power of two), items of a bucket's tuple.
K, BUCKETS, TUPLE = 8, 64, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of code points in text order; a shorter text is one k-mer, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return points
    k = min(k, len(points))
    n = len(points) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _BASE + points[i : i + n]
    return mix64(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell which occurrence of its k-mer each one is."""
    n = len(hashes)
    width = np.uint64(max(1, int(n - 1).bit_length()))
    ordered = np.sort((hashes >> width << width) | np.arange(n, dtype=np.uint64))
    place = (ordered & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    group = ordered >> width
    start = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.arange(n)
    number = at - np.maximum.accumulate(np.where(start, at, 0))
    out = hashes.copy()
    again = number > 0
    out[place[again]] = mix64(hashes[place[again]] + number[again].astype(np.uint64) * _BASE)
    return out


def signature(text: str, k: int = K, buckets: int = BUCKETS, size: int = TUPLE) -> np.ndarray:
    """A 16-bit value for each bucket; 0 where the text has no item."""
    out = np.zeros(buckets, np.uint16)
    items = kmers(text, k)
    if not len(items):
        return out
    items = numbered(items)
    shift = np.uint64(64 - int(buckets - 1).bit_length())
    if len(items) > 4 * buckets * size:
        # only items of small hash within their bucket can be chosen; the few buckets that this leaves short are redone
        low = items << np.uint64(64 - int(shift)) < np.uint64(min(2**64 - 1, 2**64 * 8 * buckets * size // len(items)))
        place = np.flatnonzero(low)
        counts = np.bincount((items[place] >> shift).astype(np.int64), minlength=buckets)
        if counts.min() < size:
            place = np.arange(len(items))
    else:
        place = np.arange(len(items))
    chosen = items[place]
    order = np.argsort(chosen)
    bucket = (chosen[order] >> shift).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    counts = np.minimum(np.diff([*first, len(bucket)]), size)
    value = np.full(len(first), 1, np.uint64)
    positions = np.full((len(first), size), np.iinfo(np.int64).max)
    for i in range(size):
        have = counts > i
        positions[have, i] = place[order[first[have] + i]]
    positions.sort(axis=1)
    for i in range(size):
        have = counts > i
        value[have] = mix64(value[have] * _BASE + items[positions[have, i]])
    out[bucket[first]] = (value % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values among the buckets that either text has; 1 for two empty texts."""
    have = (a > 0) | (b > 0)
    return float(((a == b) & have).sum() / have.sum()) if have.any() else 1.0


def _hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def _unhex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of `other`, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _row(text: str, own: np.ndarray, next_text: str, next_own: np.ndarray) -> dict:
    changed = edited(text, next_text)
    after = signature(changed)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": _hex(own),
        "edited_fingerprint": _hex(after),
        "near_edited": likeness(own, after),
        "near_next": likeness(own, next_own),
    }


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text; the fingerprint of a null text is that of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(signature(x)) for x in texts_of(batch, text_col)], pa.string())], [id_col, "fingerprint"])

    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {documents.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(documents: DataFrame) -> DataFrame:
    """FIELDS of every row: its fingerprint, that of its edited text, and how like they and the next row's are.

    Rows stand by falling doc_id (null ids last; rows of one id by the hash of their text), and the first
    follows the last; a single row follows itself. A null text is empty. Texts are dealt once, by ranges of
    that order; each range's last row meets the next range's first by an equi-join of one row for each range.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows, and of each range its first and its last row's text and signature (kinds 1 and 2)."""
        part, held = TaskContext.get().partitionId(), None

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            values = [row[0], None, None, _hex(row[2]), None, None, None]
            arrays = [pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([row[1]], pa.string())], [*_NAMES, "kind", "pid", "edge_text"])

        for batch in sliced(batches):
            out: dict = {n: [] for n in _NAMES}
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                now = (doc_id, text, signature(text))
                if held is None:
                    yield edge(1, now)
                else:
                    for name, value in {"doc_id": held[0], **_row(held[1], held[2], now[1], now[2])}.items():
                        out[name].append(value)
                held = now
            n = len(out["doc_id"])
            if n:
                arrays = [pa.array(out[name], kind) for name, kind in zip(_NAMES, _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], [*_NAMES, "kind", "pid", "edge_text"])
        if held is not None:
            yield edge(2, held)

    made = saved(dealt.mapInArrow(run, FIELDS + ", kind int, pid int, edge_text string"), "fingerprints")
    heads, tails = made.filter("kind = 1"), made.filter("kind = 2")
    parts = sorted(r.pid for r in heads.select("pid").collect())  # one number for each range
    if not parts:
        return made.select(_NAMES)
    follow = documents.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "pid int, next_pid int")
    nexts = heads.select(F.col("pid").alias("next_pid"), F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    edges = tails.join(follow, "pid").join(nexts, "next_pid").select("doc_id", F.col("edge_text").alias("text"), "fingerprint", "next_text", "next_own")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": r["doc_id"], **_row(r["text"], _unhex(r["fingerprint"]), r["next_text"], _unhex(r["next_own"]))} for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    return made.filter("kind = 0").select(_NAMES).union(edges.mapInArrow(close, FIELDS))

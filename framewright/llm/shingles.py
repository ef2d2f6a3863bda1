"""Hashed word shingles: the words, 64-bit hashes of their sequences, and shingles that many documents have."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import mix64, sliced

#: A shingle is frequent if this share of a batch's documents has it, and at least LEAST_COUNT of them.
#: By the share, there are at most (mean shingles of a document) / SHARE of them, however many documents.
SHARE, LEAST_COUNT = 8e-4, 8
#: Bytes whose words are hashed at a time; a longer word is hashed by itself.
BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_STEP = np.uint64(_ODD)
_BASE = 0x5851F42D4C957F2D

#: White space (x20, x09 to x0D) and a 64-bit value for each byte, that of A-Z like that of a-z.
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_VALUES = mix64((_FOLDED + np.uint64(1)) * _STEP)


class Words(NamedTuple):
    """Words of several texts: a hash each, their bytes data[starts:ends], and where each text begins and ends among words (bounds) and bytes (offsets)."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64."""
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([one, np.full(size, pow(_BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)
    return up, down


class Stretches:
    """Hashes of stretches of a sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(max(4096, 1 << int(len(values)).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def raw(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For values[low:high], arrays of bounds; equal for equal stretches."""
        return (self.sums[high] - self.sums[low]) * self.down[low]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64(self.raw(low, high))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string column, and offsets; null as empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, held = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_in(texts: pa.Array | Iterable[str | None]) -> Words:
    """Words of all texts (null: none): stretches without ASCII white space, A-Z in lower case."""
    data, offsets = _bytes_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    first[at] = inside[at]
    at = offsets[1:][filled] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hashed(data, starts, ends), np.searchsorted(starts, offsets), starts, ends, data, offsets)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        low = starts[k]
        n = int(np.searchsorted(ends, low + BLOCK, "right"))
        if n <= k:
            out[k] = xxhash.xxh3_64_intdigest(data[low : ends[k]].tobytes().lower())
            k += 1
            continue
        s, e = starts[k:n] - low, ends[k:n] - low
        up, down = powers(BLOCK)
        values = _VALUES[data[low : low + e[-1]]]
        values *= up[: len(values)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out[k:n] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        k = n
    return out


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words; of fewer words, one for the whole. Runs of different lengths differ."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = mix64(hashes[:n] + np.uint64(_ODD * width % 2**64))
    for i in range(1, width):
        out *= _STEP
        out += hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """sequence_hashes of each text, one after the other, and where each text's begin and end."""
    hashes, low, high = words.hashes, words.bounds[:-1], words.bounds[1:]
    if not len(hashes):
        return hashes, words.bounds
    out, kept = np.zeros(len(hashes), np.uint64), np.ones(len(hashes), bool)
    if len(hashes) >= width:
        out[: len(hashes) - width + 1] = sequence_hashes(hashes, width)
    for k in range(1, width):
        at = high - k
        kept[at[at >= low]] = False
    for i in np.flatnonzero((low < high) & (high - low < width)):
        kept[low[i]] = True
        out[low[i]] = sequence_hashes(hashes[low[i] : high[i]], width)[0]
    return out[kept], np.concatenate([[0], np.cumsum(kept)])[words.bounds]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    kept = np.empty(len(values), bool)
    kept[0] = True
    np.not_equal(values[1:], values[:-1], out=kept[1:])
    return values[kept]


def shingle_sets(texts: pa.Array | Iterable[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, bounds = shingles_of(words_in(texts), width)
    at = bounds.tolist()
    return [distinct(values[low:high]) for low, high in zip(at, at[1:], strict=False)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def frequent(documents: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that are frequent in some batch of documents; every document counts.

    They serve as an order of rarity and change no result. Each batch yields at most as many as SHARE
    allows; the union, pre-aggregated by hash, keeps those whose counts reach half the share of all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for part in sliced(iter([batch])) for x in shingle_sets(part.column(0), width)]
            if not sets:
                continue
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            many = counts >= max(LEAST_COUNT, SHARE * len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many], pa.int64())], ["h", "n"])

    rows = documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    kept = rows.filter(F.col("n") >= max(LEAST_COUNT, SHARE / 2 * documents.count())).select("h").collect()
    return np.sort(np.array([r.h for r in kept], np.int64).view(np.uint64))

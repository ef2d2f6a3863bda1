"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a doubly linked list of positions. Every adjacent pair whose joined bytes
have a rank waits in the bucket of that rank; a two-level bitmap over the ranks finds the lowest
non-empty bucket by find-first-set. An entry whose pair has changed since is stale and skipped.
Each merge costs a constant number of queue operations (and a heap step within one bucket), so a
pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewright.llm.common import arrow_map, sha256_hex, texts_of

#: A bitmap word covers 2 ** SHIFT ranks.
SHIFT, MASK = 8, 255
#: Short pre-tokens and chunks whose ids a worker remembers, in each of two generations.
CACHE_ENTRIES = 500_000
#: A space next to other white space: such texts go through the whole pattern, see `Codec.encode`.
_RUN = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: Marks that are a match of the pattern by themselves after a letter or digit at the end of a text.
_MARKS = frozenset(",.;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the leftmost pair of the lowest rank is merged next.

    The queue is written out in place, as this is the innermost loop: `buckets` holds by rank one
    position or a heap of them, `words` the bitmap of 2 ** SHIFT ranks each, `top` the bitmap of
    words that aren't 0. Positions are nodes of the linked list `before`, `after`; `waits` is the
    rank for which the pair that starts at a node waits now, so an entry of another rank is stale.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, waits = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
    top, words, buckets = 0, {}, {}
    fresh = []  # pairs to enter in the queue
    for i in range(n - 1):
        pair = piece[i : i + 2]
        if pair in ranks:
            fresh.append((ranks[pair], i))
    while True:
        for rank, i in fresh:
            waits[i] = rank
            if rank in buckets:
                held = buckets[rank]
                if type(held) is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heapq.heappush(held, i)
            else:
                buckets[rank] = i
                word = rank >> SHIFT
                if word in words:
                    words[word] |= 1 << (rank & MASK)
                else:
                    words[word] = 1 << (rank & MASK)
                    top |= 1 << word
        if not top:
            break
        word = (top & -top).bit_length() - 1  # find first set
        bits = words[word]
        rank = (word << SHIFT) + (bits & -bits).bit_length() - 1
        i = buckets[rank]
        if type(i) is not int:
            held = i
            i = heapq.heappop(held)
        else:
            held = None
        if not held:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                words[word] = bits
            else:
                del words[word]
                top &= top - 1
        fresh = []
        if waits[i] != rank:
            continue
        j = after[i]
        k = after[i] = after[j]
        waits[i] = waits[j] = -1
        before[k] = i
        if i:
            h = before[i]
            pair = piece[h:k]
            if pair in ranks:
                fresh.append((ranks[pair], h))
            else:
                waits[h] = -1
        if k < n:
            pair = piece[i : after[k]]
            if pair in ranks:
                fresh.append((ranks[pair], i))
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Remembered:
    """What was computed for short strings, in two generations of at most CACHE_ENTRIES each."""

    def __init__(self):
        self.new, self.old = {}, {}

    def put(self, key: str, value: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= 64:
            if len(self.new) >= CACHE_ENTRIES:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


class Codec:
    """Encodes texts and decodes ids by one rank file; a worker holds one per file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.ranks.values()}
        self.pattern = regex.compile(pattern)
        self.pieces, self.chunks = Remembered(), Remembered()

    def _split(self, text: str) -> tuple[int, ...]:
        """Ids by the pattern's matches, each merged on its own."""
        known, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = known.new.get(piece)
            if ids is None:
                ids = known.old.get(piece)
                ids = known.put(piece, tuple(merge(piece.encode(), self.ranks)) if ids is None else ids)
            out.append(ids)
        return tuple(chain.from_iterable(out))

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text.

        Where a space stands between two characters that aren't white space, a match of the pattern
        always begins; so texts in which every space does are cut there and the ids of such chunks
        remembered. All other texts go through the pattern as a whole.
        """
        if len(text) < 2 or text[0] == " " or text[-1] == " " or _RUN.search(text):
            return list(self._split(text))
        first, *rest = text.split(" ")
        known, out = self.chunks, [self._split(first)]
        for chunk in rest:
            ids = known.new.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
            out.append(ids)
        return list(chain.from_iterable(out))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a space and what stands up to the next one, by way of those of the chunk without its last mark."""
        known = self.chunks
        ids = known.new.get(chunk) or known.old.get(chunk)
        if ids is None:
            if len(chunk) > 1 and chunk[-1] in _MARKS and chunk[-2].isalnum():
                ids = self._chunk(chunk[:-1]) + self._split(chunk[-1])
            else:
                ids = self._split(" " + chunk)
        return known.put(chunk, ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; null and empty texts have no ids. Other columns are left out; repeated rows stay."""

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        return {id_col: batch.column(0), "ids": [own.encode(x) for x in texts_of(batch, text_col)]}

    return arrow_map(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of every list of ids; a null list decodes to no bytes, an unknown id raises KeyError."""

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        return {id_col: batch.column(0), "bytes": [own.decode(x or []) for x in batch.column(1).to_pylist()]}

    return arrow_map(df.select(id_col, ids_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its text encoded, then the ids decoded.

    A null text counts as empty: no ids, and both digests are those of no bytes. Rows with a null id or
    an equal id stay as they are; other columns don't matter.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts_of(batch):
            ids = own.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256_hex(" ".join(map(own.digits.__getitem__, ids)).encode()))
            out["decoded_sha256"].append(sha256_hex(own.decode(ids)))
        return out

    return arrow_map(df.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

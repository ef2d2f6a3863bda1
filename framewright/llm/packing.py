"""Order-preserving packing of documents into sequences by dynamic programming.

Documents are one token stream in input order, cut into windows of at most `limit` tokens. Cuts may
stand at document ends, sentence ends and, inside sentences longer than STEP, every STEP tokens.
The cost of a window is its padding plus a penalty for what its end cuts; a monotone queue over the
last `limit` tokens gives each cut's best predecessor in constant amortised time. Windows whose
length is a power of two need no padding and are looked up as extra predecessors.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from framewright.llm.common import sliced, texts_of

#: Tokens of a sequence.
LIMIT = 1024
#: Closing id of every document.
END_ID = 0
#: Costs of a cut after a sentence and within one, in tokens of padding.
SENTENCE_COST, WITHIN_COST = 1.0, 16.0
#: Cost of every window, so that short ones of a power of two don't take the place of full ones.
WINDOW_COST = 6.0
#: Distance of the cuts allowed within long sentences.
STEP = 64
#: Tokens after which a task settles its windows but for the last two.
BLOCK = 1 << 19

#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Whole texts to the ids that the tokenizers library gives, without special tokens around them.

    For a byte-level vocabulary whose ids ascend with its merges, tiktoken gives the same ids by ranks, in less than a fifth
    of the time; so all texts go that way but those that hold an added token or that it refuses, and all of them with other vocabularies.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        names = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        # "Ċ" stands for a line break in byte-level vocabularies
        self.ends = np.array([name.endswith((".", "!", "?")) or "Ċ" in name for name in names])
        ranks = _ranks(self.tokenizer)
        self.ranked = tiktoken.Encoding("by ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit words."""
        if self.ranked is not None and not any(x in text for x in self.added):
            try:
                return array("I", self.ranked.encode_ordinary(text)).tobytes()
            except BaseException as error:  # its regular expressions give up on some very long texts, by an exception of their own
                if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _ranks(tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """Bytes and id of each token, if the tokenizer is a plain byte-level BPE whose ids ascend with its merges; else None."""
    parts = json.loads(tokenizer.to_str())
    model, before = parts["model"], parts.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not plain or parts.get("normalizer") or before != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}:
        return None
    added = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in added}
    merges = ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
    ids = [*sorted(vocabulary.get(c, -1) for c in _CHARACTERS), *(vocabulary.get(token, -1) for token in merges)]
    if len(ids) != len(vocabulary) or ids[0] < 0 or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return None
    return {bytes(map(_CHARACTERS.__getitem__, token)): i for token, i in vocabulary.items()}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Cut positions of least cost, from 0 to the last document's end."""
    total = len(ids)
    if not total:
        return [0]
    is_end = np.zeros(total + 1, bool)
    is_end[1:] = ends[ids]
    is_end[document_ends] = True
    is_end[0] = is_end[total] = True
    at = np.flatnonzero(is_end)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STEP)
    within = np.concatenate([np.arange(at[k] + STEP, at[k + 1], STEP) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    cost = np.full(total + 1, WINDOW_COST + SENTENCE_COST)
    cost[within] = WINDOW_COST + WITHIN_COST
    cost[document_ends] = WINDOW_COST
    cost[total] = WINDOW_COST
    at = np.union1d(at, within)
    exact: dict[int, list[int]] = {}
    power = 1
    while power < limit:
        found = np.searchsorted(at, at - power)
        for j in np.flatnonzero(at[np.minimum(found, len(at) - 1)] == at - power).tolist():
            exact.setdefault(j, []).append(int(found[j]))
        power *= 2
    pos, pen = at.tolist(), cost[at].tolist()
    n = len(pos)
    best, key, back = [0.0] * n, [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        low = key[i] + limit - p
        if j in exact:
            for h in exact[j]:
                if best[h] < low:
                    low, i = best[h], h
        low += pen[j]
        best[j], back[j] = low, i
        low += p
        key[j] = low
        while queue and key[queue[-1]] >= low:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return [0, *reversed(out)]


class Packer:
    """Windows of one task's documents, in blocks; a block's last two windows are decided anew with the next one."""

    def __init__(self, ends: np.ndarray, part: int, limit: int = LIMIT, block: int = BLOCK):
        self.ends, self.limit, self.block = ends, limit, block
        self.next_sequence, self.waiting, self.size = part << 32, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Take a document's ids; returns pieces that are settled: (doc_id, start, length, crc32, doc_tokens, sequence_id, offset)."""
        self.waiting.append((doc_id, ids, 0))
        self.size += len(ids) // 4
        return self.settle(False) if self.size >= self.block else []

    def settle(self, last: bool) -> list[tuple]:
        lengths = [len(ids) // 4 - start for _, ids, start in self.waiting]
        doc_ends = np.cumsum(lengths, dtype=np.int64)
        stream = np.frombuffer(b"".join(ids[4 * start :] for _, ids, start in self.waiting), "<u4")
        places = cuts(stream, doc_ends, self.ends, self.limit)
        if not last:
            places = places[:-2] if len(places) > 3 else places[:1]
        out, k, held = [], 0, 0  # document k, of which `held` waiting tokens are packed
        for low, high in zip(places, places[1:], strict=False):
            offset = 0
            while offset < high - low:
                doc_id, ids, start = self.waiting[k]
                length = min(lengths[k] - held, high - low - offset)
                at = start + held
                out.append((doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), len(ids) // 4, self.next_sequence, offset))
                offset += length
                held += length
                if held == lengths[k]:
                    k, held = k + 1, 0
            self.next_sequence += 1
        rest = self.waiting[k:]
        if rest and held:
            rest[0] = (rest[0][0], rest[0][1], rest[0][2] + held)
        self.waiting, self.size = rest, int(doc_ends[-1] - places[-1]) if lengths else 0
        return out


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document in a sequence, in document order within each input partition.

    A document is its text's ids and END_ID; a null or empty text is END_ID alone. Every id lies in
    exactly one piece; offsets in a sequence run from 0 without gaps; sequence ids are unique, the
    partition in the upper 32 bits. Only each partition's last sequence can be padded by more than the
    cost of the next better cut. Repeated rows are documents of their own, ids may be null, other
    columns don't matter, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(encode.ends, TaskContext.get().partitionId(), limit, block)
        close = np.array([END_ID], "<u4").tobytes()
        names = [x.split()[0] for x in PIECE.split(", ")]

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names)

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                yield from rows(packer.add(doc_id, encode(text) + close))
        if packer.waiting:
            yield from rows(packer.settle(True))

    return documents.select("doc_id", "text").mapInArrow(run, PIECE)

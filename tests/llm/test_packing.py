from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from framewright.llm import packing as K

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "'s", "'", "ab", "1", "23", "_", "!!", "\x1c", "\x85", "\xa0", "日本", "<|endoftext|>", "½", "the", "ing", ",", ".", "?"]


def test_ids_are_the_library_s():
    library, draw = Tokenizer.from_file(PATH), random.Random(1)
    own = K.encoder(PATH)
    for _ in range(3000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 25)))
        assert own(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def cost(places, candidates, limit):
    total = 0.0
    for low, high in zip(places, places[1:], strict=False):
        n = high - low
        total += candidates[high] + (0 if n & (n - 1) == 0 else limit - n)
    return total


def test_cuts_are_of_least_cost():
    draw = np.random.default_rng(4)
    for _ in range(60):
        n, limit = int(draw.integers(1, 60)), 16
        ids = draw.integers(0, 4, n).astype(np.uint32)
        ends = np.array([True, False, False, False])
        docs = np.unique(np.append(draw.integers(1, n + 1, 3), n))
        old, K.STEP = K.STEP, 4
        try:
            got = K.cuts(ids, docs, ends, limit)
        finally:
            K.STEP = old
        penalty = {int(i) + 1: K.WINDOW_COST + K.SENTENCE_COST for i in np.flatnonzero(ends[ids])}
        penalty |= {int(d): K.WINDOW_COST for d in docs} | {n: K.WINDOW_COST}
        marks = [0, *sorted(penalty)]
        for a, b in zip(marks, marks[1:], strict=False):
            penalty |= {k: K.WINDOW_COST + K.WITHIN_COST for k in range(a + 4, b, 4)}
        best = {0: 0.0}
        for j in sorted(penalty):
            best[j] = min(best[i] + penalty[j] + (0 if (j - i) & (j - i - 1) == 0 else limit - (j - i)) for i in best if 0 < j - i <= limit)
        assert got[0] == 0 and got[-1] == n and abs(cost(got, penalty, limit) - best[n]) < 1e-9


def test_pieces_hold_every_id_once(spark):
    draw = random.Random(2)
    texts = {i: " ".join(draw.choices(["the", "cat.", "sat", "Mat!", "on\n"], k=draw.choice([0, 3, 40, 700]))) for i in range(60)} | {100: "x" * 9000, 101: None, 102: ""}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(101, None, 1)], "doc_id long, text string, offset int").repartition(3)
    rows = K.pack(docs, PATH, block=3000).collect()
    own, by_seq, by_doc = K.encoder(PATH), {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = own(texts[i] or "") + b"\0\0\0\0"
        if i == 101:
            assert [(p.start, p.length) for p in pieces] == [(0, 1)] * 2
            continue
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    assert K.pack(docs.limit(0), PATH).count() == 0


def test_little_padding():
    draw, packer = random.Random(6), K.Packer(K.encoder(PATH).ends, 0)
    own, sizes = K.encoder(PATH), {}
    pieces = []
    for i in range(300):
        pieces += packer.add(i, own(" ".join(draw.choices(["the", "cat.", "sat", "mat", "on"], k=draw.randint(5, 800)))) + b"\0\0\0\0")
    for p in pieces + packer.settle(True):
        sizes[p[5]] = sizes.get(p[5], 0) + p[2]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes.values())
    assert padding < 0.03 * sum(sizes.values())

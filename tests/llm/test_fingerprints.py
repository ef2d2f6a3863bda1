from __future__ import annotations

import hashlib
import random

import numpy as np

from framewright.llm import fingerprints as K


def plain(text: str, k=K.K, buckets=K.BUCKETS, size=K.TUPLE) -> np.ndarray:
    """The signature by its definition, item by item."""
    hashes = K.kmers(text, k).tolist()
    seen, items = {}, []
    for place, h in enumerate(hashes):
        number = seen.get(h >> max(1, (len(hashes) - 1).bit_length()), 0)
        seen[h >> max(1, (len(hashes) - 1).bit_length())] = number + 1
        items.append((int(K.mix64(np.array([h], np.uint64) + np.uint64(number) * np.array([K._BASE]))[0]) if number else h, place))
    out = np.zeros(buckets, np.uint16)
    for b in range(buckets):
        least = sorted(x for x in items if x[0] >> 58 == b)[:size]
        value = np.ones(1, np.uint64)
        for h, _ in sorted(least, key=lambda x: x[1]):
            value = K.mix64(value * K._BASE + np.uint64(h))
        if least:
            out[b] = int(value[0]) % 65535 + 1
    return out


def test_signature_by_definition():
    draw = random.Random(3)
    for text in ["", "a", "abcdefg", "abcdefgh", "ab" * 400, *("".join(draw.choices("abcé 日", k=n)) for n in (9, 40, 300, 4000))]:
        assert (K.signature(text) == plain(text)).all(), text[:20]


def test_order_matters():
    draw = random.Random(1)
    a, b = ("".join(draw.choices("abcdefgh ", k=2000)) for _ in range(2))
    one = K.signature(a + b)
    assert K.likeness(one, K.signature(a + b)) == 1.0
    assert K.likeness(one, K.signature(a + b[:1900])) > 0.8 > K.likeness(one, K.signature(b + a)) > 0.0
    assert K.likeness(one, K.signature("".join(draw.choices("uvwxyz", k=4000)))) == 0.0


def test_every_row_meets_its_next(spark):
    draw = random.Random(2)
    rows = [(i, "".join(draw.choices("abc d", k=draw.randint(0, 60)))) for i in range(200)] + [(500, "x" * 20_000)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, edge_text string").repartition(5)
    found = {r.doc_id: r for r in K.with_next(docs).collect()}
    ordered = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own = K.signature(text)
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (K._hex(own), K._hex(K.signature(changed)))
        assert (r.near_edited, r.near_next) == (K.likeness(own, K.signature(changed)), K.likeness(own, K.signature(after)))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, ""), (None, "abc")], "doc_id long, text string")
    assert K.with_next(docs).count() == 4 and K.with_next(docs.limit(0)).count() == 0
    alone = K.with_next(docs.filter("doc_id = 1")).first()
    assert (alone.near_next, alone.n_chars) == (1.0, 1)
    assert {len(r.fingerprint) for r in K.fingerprints(docs).collect()} == {4 * K.BUCKETS}

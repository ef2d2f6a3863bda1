"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str | None, width: int) -> frozenset:
    x = words(text)
    return frozenset(tuple(x[i : i + width]) for i in range(len(x) - width + 1)) if len(x) >= width else frozenset([tuple(x)] if x else [])


def classes(rows: list[tuple], width: int, percent: int) -> dict:
    """doc_id: (set size, least doc_id reachable)."""
    sets: dict = {}
    for i, text in rows:
        sets.setdefault(i, shingles(text, width))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated_words(rows: list[tuple], length: int) -> dict:
    """doc_id: places of words in a stretch of `length` words that an earlier document has."""
    first, hit = {}, defaultdict(set)
    for i, text in sorted(rows):
        x = words(text)
        own = [tuple(x[k : k + length]) for k in range(len(x) - length + 1)]
        for k, stretch in enumerate(own):
            if first.get(stretch, i) != i:
                hit[i].update(range(k, k + length))
        for stretch in own:
            first.setdefault(stretch, i)
    return hit

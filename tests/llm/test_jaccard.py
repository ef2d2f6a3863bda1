from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import jaccard as J
from framewright.llm.components import components
from framewright.llm.shingles import shingle_set
from tests.llm import brute

SCHEMA = "doc_id long, text string, n string, root string"


def corpus(seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefg", k=3))
    rows, common = [], [word() for _ in range(30)]
    for group in range(30):
        base = [word() for _ in range(draw.choice([3, 10, 60, 200]))] + (common if group % 3 == 0 else [])
        for _ in range(draw.choice([1, 2, 5, 25])):
            x = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                x[draw.randrange(len(x))] = word()
            rows.append((len(rows), draw.choice([" ", "\n", " \t "]).join(x).upper() if draw.random() < 0.2 else " ".join(x)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two three"), (1006, "é É"), (1007, "É é"), rows[0], (1008, "x " * 3000)]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_classes_like_all_pairs(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "q", "q") for r in rows], SCHEMA).repartition(3)
    found = J.similar_classes(docs, width, percent).collect()
    want = brute.classes(rows, width, percent)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    stay = {r.doc_id for r in J.one_of_each(docs, width, percent).collect()}
    assert stay == {i for i, (_, root) in want.items() if i == root}


def test_groups_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    rows = corpus(7)[:60]
    found = J.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.classes(rows, 4, 85)


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in J.similar_classes(docs).collect()) == [(0, 0), (0, 0), (1, 1)]
    assert J.one_of_each(docs).count() == 3
    assert J.similar_classes(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=60), st.sampled_from([50, 80, 85, 100]))
def test_tree_loses_no_link(lists, percent):
    sets = sorted((shingle_set(" ".join(map(str, sorted(set(x)))), 1) for x in lists), key=len)
    sizes = np.array([len(s) for s in sets], np.int64)
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
    labels = J.linked(sizes, [J.bitmap(s) for s in sets], percent, near)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near(i, j):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert labels.tolist() == want


def test_widths_meet_at_their_border(monkeypatch):
    monkeypatch.setattr(J, "LEAST_BITS", 64)
    draw = random.Random(8)
    sets = []
    for n in (58, 60, 63, 64, 66, 70, 120, 127, 129, 140, 250, 262, 600):
        base = draw.sample(range(10**6), n)
        sets += [shingle_set(" ".join(map(str, base[: n - cut])), 1) for cut in (0, 2, n // 12)]
    sets.sort(key=len)
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    labels = J.linked(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], 85, near)
    for i in range(len(sets)):
        for j in range(i):
            assert not near(i, j) or labels[i] == labels[j]
    assert len(set(labels.tolist())) == 13


def test_folding_keeps_bits():
    small, large = shingle_set("a b c", 1), shingle_set(" ".join(map(str, range(3000))), 1)
    assert len(J.bitmap(large)) == 512 and J.folded([J.bitmap(small), J.bitmap(large)]).shape == (2, 16)


def test_large_blocks_are_dealt_without_loss(spark):
    from pyspark.sql import functions as F

    members = spark.range(50).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.lit(50).alias("m"))
    pairs = set()
    for row in J.dealt(members, "key", "rep", 12).groupBy("a", "b").agg(F.collect_list("rep").alias("x")).collect():
        assert len(row.x) < 50
        pairs |= {(i, j) for i in row.x for j in row.x if i < j}
    assert len(pairs) == 50 * 49 // 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 90)] + [(3, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 90)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

"""Top-k search, product codes and clustering against brute force in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import clusters as C
from framewright.llm import codes as K
from framewright.llm import topk as T
from framewright.llm.queries import oracle_sql, queries
from tests.compare import canonical, duck

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, length string, raw string, labels string, cluster string, block string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(3)


def vectors(n=260, d=16, seed=1, spread=1.0):
    """Vectors of several directions and lengths, copies of one, repeated ids and rows, and such as hold no finite vector."""
    draw = random.Random(seed)
    base = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre, size = draw.choice(base), draw.choice([0.1, 1.0, spread])
        rows.append((i, [float(np.float32(size * (x + draw.gauss(0, 0.2)))) for x in centre], draw.choice([0, 1, None])))
    rows += [(1000 + i, rows[7][1], 3) for i in range(90)] + [rows[3], (100, rows[5][1], 1), (None, rows[100][1], None), (300, [0.0] * d, 1)]
    return rows + [(400, None, 1), (500, [math.nan] + [0.0] * (d - 1), 1), (600, [math.inf] * d, 2), (700, [None] * d, 2)]


def kept(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def best_of_all(rows, k, scale, step=100):
    held, out = kept(rows, scale), []
    for a, (i, q, _) in enumerate(held):
        if i is not None and i % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0) for b, (j, v, _) in enumerate(held) if a != b)
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "bounds", "seeds"), [(T.QUERY_BYTES, T.BOUNDS, T.SEEDS), (300, 64, 12), (300, 64, 0)])
def test_top_k_like_all_pairs(spark, monkeypatch, block, bounds, seeds):
    monkeypatch.setattr(T, "QUERY_BYTES", block)
    monkeypatch.setattr(T, "BOUNDS", bounds)
    monkeypatch.setattr(T, "SEEDS", max(seeds, 1))
    rows = vectors(spread=30.0)
    found = T.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, 5, 1024)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in found.collect()) == best_of_all(rows, 5, 1024)


def test_top_k_with_few_or_odd_vectors(spark):
    asks = F.col("vec_id") % 100 == 0
    assert T.top_k(table(spark, []), asks).count() == 0
    assert T.top_k(table(spark, [(1, [1.0], 0)]), asks).count() == 0 and T.top_k(table(spark, [(100, [1.0], 0)]), asks).count() == 0
    rows = [(100, [1.0, -2.0], 0), (100, [], 0), (7, [3.0, 1.0, 5.0], 0), (8, [0.5], 0), (9, None, 0)]
    assert sorted(str(tuple(r)) for r in T.top_k(table(spark, rows), asks, 10, 2).collect()) == best_of_all(rows, 10, 2)
    with pytest.raises(Exception, match="exactly in 64 bits"):
        T.top_k(table(spark, [(100, [1e9, 1.0], 0), (1, [1e9, 1.0], 0)]), asks).count()


def test_top_k_prunes(spark):
    """Of vectors of falling length far fewer products are computed than there are pairs; shorter files aren't read at all."""
    draw = np.random.default_rng(3)
    v = (draw.normal(size=(4000, 16)) * np.geomspace(1, 0.001, 16)).astype(np.float32) / np.arange(1, 4001)[:, None]
    seen, real = [], np.einsum
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = np.floor(1024.0 * v.astype(np.float64)).astype(np.int64)
    length = np.sqrt((q * q).sum(axis=1).astype(float))
    order = np.argsort(-length, kind="stable")
    ids = {"row": order, "id": order, "no_id": np.zeros(4000, bool), "length": length[order], "v": q[order]}
    asked = {n: x[ids["id"] % 100 == 0] for n, x in ids.items()}
    energy, rotation = np.linalg.eigh((q.T @ q).astype(float))
    rotated = asked["v"] @ rotation[:, ::-1]
    known = asked | {"head": rotated[:, :2].copy(), "rest": np.linalg.norm(rotated[:, 2:], axis=1), "rotation": np.ascontiguousarray(rotation[:, ::-1])}
    best = T._Best(len(asked["row"]), 10, np.full(len(asked["row"]), T._LEAST))
    with mock.patch.object(T.np, "einsum", lambda *a: (seen.append(len(a[1])), real(*a))[1]), mock.patch.object(T, "_products", lambda a, b: (seen.append(len(a) * len(b)), a @ b.T)[1]):
        for at in range(0, 4000, 100):
            part = slice(at, at + 100)
            batch = pa.RecordBatch.from_arrays([pa.array(ids["row"][part]), pa.array(ids["id"][part]), pa.array(list(ids["v"][part])), pa.array(ids["length"][part])], ["row", "vec_id", "v", "length"])
            T._compare(known, best, batch, 16, 2)
    assert sum(seen) < 0.2 * 40 * 4000
    scores = asked["v"] @ ids["v"].T
    scores[asked["row"][:, None] == ids["row"][None]] = T._LEAST
    assert (best.score == np.sort(scores, axis=1)[:, :-11:-1]).all()
    assert sorted(str(tuple(r)) for r in T.top_k(df, F.col("vec_id") % 100 == 0).collect()) == best_of_all([(i, x.tolist(), 0) for i, x in enumerate(v)], 10, 1024)


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), n) for n, e in enumerate(entries))


def means(members, entries):
    return [[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := members.get(n)) else e for n, e in enumerate(entries)]


def brute_codes(rows, parts, entries, rounds, scale):
    held = kept(rows, scale)
    wide = len(held[0][1]) // parts
    first = {}
    for i, v, _ in held:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[first[i][p * wide : (p + 1) * wide] for i in sorted(first)[:entries]] for p in range(parts)]
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in held]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = means(members, books[p])
    return sorted(str((i, label, [nearest(c[p], books[p])[1] for p in range(parts)], sum(nearest(c[p], books[p])[0] for p in range(parts)))) for (i, _, label), c in zip(held, cut, strict=True)), books


@pytest.mark.parametrize("block", [K.BLOCK_BYTES, 16 * 4 * 40])
def test_codes_like_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rows = vectors()
    found, books = K.codes(table(spark, rows), 4, 6, 5, 16)
    want, want_books = brute_codes(rows, 4, 6, 5, 16)
    assert books.tolist() == want_books
    assert sorted(str((r.vec_id, r.label, r.codes, r.error)) for r in found.collect()) == want
    text = found.withColumn("code", K.code_text(F.col("codes"))).first()
    assert text.code == "".join(f"{c:02x}" for c in text.codes)
    assert K.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    assert K.codes(table(spark, []))[0].count() == 0 and K.codes(table(spark, [(1, None, 0), (2, [], 1)]))[0].count() == 0
    rows = [(5, [1.0, 2.0], 1), (None, [3.0, 4.0], 1), (1, [1.0, 2.0, 3.0], 0), (2, [9.0], 0), (7, [3.0, 5.0, 6.0, 7.0], 0)]
    found, books = K.codes(table(spark, rows), 2, 4, 3, 1)
    assert sorted((r.vec_id or 0, r.error) for r in found.collect()) == [(0, 2), (5, 2)] and books.tolist() == [[[2]], [[3]]]
    found, books = K.codes(table(spark, [(None, [3.0, 4.0], 1)] * 3), 2, 4, 3, 1)
    assert [r.error for r in found.collect()] == [0, 0, 0] and books.shape == (2, 1, 1)


@pytest.mark.parametrize("few", [K.FEW_LABELS, 1])
def test_errors_by_label(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_LABELS", few)
    rows = [(i, label, [i % 3], i) for i, label in enumerate([1, 1, None, 2, None, 1] * 20)]
    found = K.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, codes array<int>, error long")).collect()
    sums = {}
    for _, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert len(found) == 120 and all(r.label_error == sums[r.label] for r in found)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 4), st.integers(1, 9), st.sampled_from([2, 5, 300]))
def test_filtering_like_comparing_all(seed, n, d, k, size):
    """Few distinct values give many ties and equal entries."""
    draw = np.random.default_rng(seed)
    points, entries = draw.integers(-size, size, (n, d)).astype(np.int32), draw.integers(-size, size, (k, d))
    sums, counts, chosen = K.filtered(K.grown(points), points, entries, rows=True)
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (chosen == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def brute_clusters(rows, k, rounds, scale):
    held = [x for x in kept(rows, scale)]
    start = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v, _ in held)[:k]
    centroids = [v for _, _, v in start]
    for _ in range(rounds):
        members = {}
        for _, v, _ in held:
            members.setdefault(nearest(v, centroids)[1], []).append(v)
        centroids = means(members, centroids)
    return sorted(str((i, *reversed(nearest(v, centroids)))) for i, v, _ in held), centroids


@pytest.mark.parametrize(("block", "k", "scale"), [(C.BLOCK_BYTES, 16, 64), (16 * 4 * 40, 16, 2), (16 * 4 * 40, 1, 8)])
def test_clusters_like_plain_rounds(spark, monkeypatch, block, k, scale):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rows = vectors() + [(800, [1.0] * 15, 0), (801, [], 0)]
    found, centroids = C.clusters(table(spark, rows), k, 3, scale, 16)
    want, want_centroids = brute_clusters(rows[:-2], k, 3, scale)
    assert centroids.tolist() == want_centroids
    assert sorted(str((r.vec_id, r.cluster, r.distance)) for r in found.collect()) == want
    full = C.with_inertia(found, centroids).collect()
    assert {r.inertia for r in full} == {sum(r.distance for r in full)} and sum({r.cluster: r.cluster_inertia for r in full}.values()) == full[0].inertia
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centroids[r.cluster])).encode()).hexdigest() for r in full)


def test_clusters_of_odd_tables(spark):
    found, centroids = C.clusters(table(spark, []))
    assert C.with_inertia(found, centroids).count() == 0
    found, centroids = C.clusters(table(spark, [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, None, 0), (2, [3.0, 3.0], 0)]), 16, 3, 1, 2)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == [(0, 1, 0), (0, 1, 0), (2, 0, 0)] and len(centroids) == 3


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 80), st.integers(1, 4), st.integers(1, 9), st.sampled_from([2, 5, 300]))
def test_exponion_rounds_like_looking_at_all(seed, n, d, k, size):
    draw = np.random.default_rng(seed)
    points, centroids = draw.integers(-size, size, (n, d)).astype(np.int32), draw.integers(-size, size, (k, d))
    cluster, upper, lower = C.first_found(points, centroids)
    for _ in range(4):
        want = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == want.argmin(axis=1)).all()
        new = np.array([points[cluster == c].astype(np.int64).sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(k)])
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1)) * (1 + C.SLACK)
        centroids = new
        cluster, upper, lower, _ = C.found(points, centroids, C.near(centroids), cluster, *C.drifted(cluster, upper, lower, moved))


def test_exponion_looks_at_few():
    draw = np.random.default_rng(8)
    centroids = draw.integers(-1000, 1000, (40, 2))
    points = (centroids[draw.integers(0, 40, 4000)] + draw.integers(-30, 30, (4000, 2))).astype(np.int32)
    cluster, upper, lower = C.first_found(points, centroids)
    moved = np.full(40, 40.0)
    taken = C.found(points, centroids, C.near(centroids), cluster, *C.drifted(cluster, upper, lower, moved))[3]
    assert taken < 0.1 * 40 * 4000


@pytest.mark.parametrize("name", ["op11_topk", "op12_codes", "op13_clusters"])
def test_vector_queries_agree_with_sql(spark, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), duck(SF, oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)

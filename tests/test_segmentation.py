from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import functions as F

from framewright.functions.tensors import argmax, sigmoid, softmax
from framewright.operators import diagnostics, rendering
from framewright.operators import segmentation as S
from framewright.plans import sinks
from framewright.plans.ranking import ranked

QUERY = "frame int, query int, logits array<float>, mask array<float>, mask_h int, mask_w int"
PAINT = "frame int, query int, class int, fg_prob double, mask array<float>, mask_h int, mask_w int"


def test_softmax_sigmoid_and_first_argmax(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "v array<float>").select(softmax(F.col("v")).alias("p"), argmax(F.col("v")).alias("a"), sigmoid(F.lit(0.0)).alias("s")).first()
    e = np.exp(np.array([1, 3, 3, -2]) - 3.0)
    assert np.allclose(row.p, e / e.sum()) and row.a == 1 and row.s == 0.5


def test_valid_queries_are_strict_and_never_nan(spark):
    half = math.log(1.0)
    rows = [(0, 0, [5.0, 0.0, 0.0]), (0, 1, [half, -90.0, half]), (0, 2, [0.0, 0.0, 5.0]), (0, 3, [math.nan, 9.0, 0.0]), (0, 4, [4.0, 4.0, 9.0])]
    found = S.valid_queries(spark.createDataFrame([(f, q, x, [1.0], 1, 1) for f, q, x in rows], QUERY)).collect()
    assert [(r.query, r["class"]) for r in found] == [(0, 0)]


def test_area_limit_keeps_its_bound(spark):
    masks = [(0, 0, 1, 0.9, [1.0] * 49 + [-1.0] * 15, 8, 8), (0, 1, 2, 0.9, [1.0] * 50 + [0.0] * 14, 8, 8), (0, 2, 2, 0.9, [math.nan] * 64, 8, 8)]
    assert [(r.query, r.area) for r in S.surviving(spark.createDataFrame(masks, PAINT)).collect()] == [(1, 50)]


def paint(queries, height, width):
    best, labels = np.zeros(height * width), np.zeros(height * width, int)
    for _, _, kind, fg, mask, _, _ in sorted(queries, key=lambda q: q[1]):
        with np.errstate(invalid="ignore"):
            w = fg / (1 + np.exp(-np.array(mask, float)))
            over = w > best
        best[over], labels[over] = w[over], kind
    return labels.reshape(height, width)


def edges(labels):
    out = np.zeros(labels.shape, bool)
    for y, x in np.ndindex(labels.shape):
        near = [labels[v, u] if 0 <= v < labels.shape[0] and 0 <= u < labels.shape[1] else None for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))]
        out[y, x] = labels[y, x] != 0 and any(n != labels[y, x] for n in near)
    return out


def frame_cases(seed=3, n=40):
    draw = np.random.default_rng(seed)
    for f in range(n):
        h, w = int(draw.integers(1, 6)), int(draw.integers(1, 6))
        values = draw.choice([-3.0, -1.0, 0.0, 1.0, 2.0, -800.0, math.nan], (int(draw.integers(0, 5)), h * w))
        yield f, h, w, [(f, q, int(draw.integers(0, 4)), float(draw.choice([0.6, 0.75, 0.9])), v.tolist(), h, w) for q, v in enumerate(values)]


def test_label_map_boundary_and_dense_form_like_sequential_painting(spark):
    cases = list(frame_cases())
    kept = spark.createDataFrame([q for c in cases for q in c[3]], PAINT)
    frames = spark.createDataFrame([c[:3] for c in cases], "frame int, height int, width int")
    labels = S.label_map(kept, frames).persist()
    out = {f: np.zeros((h, w), int) for f, h, w, _ in cases}
    border = {f: np.zeros((h, w), bool) for f, h, w, _ in cases}
    for r in S.boundary(labels).collect():
        out[r.frame][r.y, r.x], border[r.frame][r.y, r.x] = r.label, r.is_boundary
    sized = kept.join(frames, "frame")
    dense = {r.frame: np.array(r.labels).reshape(r.height, r.width) for r in S.dense_label_map(sized, 0).collect()}
    for f, h, w, queries in cases:
        want = paint(queries, h, w)
        assert (out[f] == want).all() and (border[f] == edges(want)).all()
        if queries:
            assert (dense[f] == want).all()
    content = {r.frame: r.content for r in sinks.png_column(S.dense_label_map(sized, 0)).collect()}
    assert all(c.startswith(b"\x89PNG") for c in content.values())


def test_stats_centres_coverage_and_ties(spark):
    labels = spark.createDataFrame([(0, y, x, (1 if x < 2 else 2) if y < 2 else 0) for y in range(4) for x in range(4)], "frame int, y int, x int, label int")
    stats = {r.label: (r.n_pixels, r.cx, r.cy, r.share_pct) for r in S.class_stats(labels).collect()}
    assert stats == {0: (8, 1, 2, 50.0), 1: (4, 0, 0, 25.0), 2: (4, 2, 0, 25.0)}
    top = S.top_classes(S.class_stats(labels), 1).collect()
    assert [(r.label, r.name, r.caption) for r in top] == [(1, "building", "building\n25.0%")]
    assert S.coverage(S.class_stats(labels)).first().asDict() == {"frame": 0, "n_labels": 2, "coverage_pct": 50.0}


# The 150 class colours, worked out in fractions from the table of hues' bends and the seeded values.
PALETTE = """
b40000 c30400 e61000 b91500 b41900 d92800 c12c00 dc3800 df4300 b23e00 e75b00 be4f00 cc5e00 b95e00 e07700
ea8700 fc9e00 dc9400 e19c00 dea500 b68f00 c8a200 c4a800 c7b400 cebf00 c0ba00 f3f800 d2e100 d5ea00 b3cf00
bae300 b7e600 b2ed00 7fb400 82c600 9efa00 76ca00 70d000 6ed500 5dc500 54c600 63f700 45c300 43d900 2fb600
36e200 28d200 1ecf00 1bda00 12f400 07e900 03db06 01e30a 00d311 00fb20 00c61e 00c026 00f53c 00e33d 00be3c
00db4f 00db59 00cb57 00f977 00f27f 00b664 00fa95 00d78a 00eca2 00bc85 00dca6 00f5c4 00c2a0 00eacc 00cab9
00e4dc 00dad7 00bcc3 00cddf 00afc3 00c0e2 00c7f7 008fb7 00a8e5 0081bc 008ede 0093ee 006ec1 006fd3 006bd6
0068e6 004cba 004acc 0043c5 003ed4 0031c7 0037f9 002bf4 0018b6 001af2 000ff9 0206bf 0600c2 0900b6 1900fd
2200ee 2300d2 3600fe 3d00e9 3d00c9 4900de 5900eb 5e00df 6c00f3 7c00fb 6800c0 8100e6 7200bb 8100c5 9e00e1
a100df c000fa be00e9 af00d0 b200c9 dc00ec cf00d3 f900f8 c100b8 f900e2 f500d8 be009f e800b7 fe00c2 b30080
c90087 fa009c bb0071 dc007a e00072 c2005e c60057 f70061 b90040 c70040 ed0042 c6002e dc002e b3001d f6001c
""".split()


def test_palette_is_the_fixed_one():
    assert ["".join(f"{int(c * 255):02x}" for c in rgb) for _, *rgb in rendering.colours()] == PALETTE


def test_heads_are_made_once(spark):
    """Each condition on a head's columns would repeat its sums, were the filter pushed below them."""
    q = spark.createDataFrame([(0, i, [float(i), 0.0, 0.0], [0.0, 2.0], 1, 2) for i in range(12)], QUERY)
    plan = S.valid_queries(q).select("frame", "query", "class", "fg_prob")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    plan = diagnostics.query_counts(q, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("LocalRelation") + plan.count("LogicalRDD") == 1
    found = diagnostics.query_counts(q, 1).first().asDict()
    assert found == {"frame": 0, "n_queries": 12, "n_valid": S.valid_queries(q).count(), "n_kept": S.surviving(S.valid_queries(q), 1).count()}


def test_dense_maps_are_counted_and_outlined_without_pixel_rows(spark):
    draw = np.random.default_rng(6)
    maps = {0: np.zeros((3, 4), int), 1: np.full((1, 1), 9), 2: draw.integers(0, 3, (7, 5)), 3: draw.integers(0, 200, (9, 9)), 4: np.kron(draw.integers(0, 4, (4, 4)), np.ones((3, 3), int))}
    dense = spark.createDataFrame([(f, *m.shape, m.ravel().tolist()) for f, m in maps.items()], "frame int, height int, width int, labels array<int>")
    pixels = [(f, int(y), int(x), int(m[y, x])) for f, m in maps.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    rows = spark.createDataFrame(pixels, "frame int, y int, x int, label int")
    as_set = lambda df: {tuple(r) for r in df.select("frame", "label", "n_pixels", "cx", "cy", "share_pct").collect()}
    assert as_set(S.dense_class_stats(dense)) == as_set(S.class_stats(rows))
    for r in S.dense_boundary(dense).collect():
        assert (np.array(r.is_boundary).reshape(r.height, r.width) == edges(maps[r.frame])).all()
    parts = [(f, len(p), m.shape[1], p.ravel().tolist(), top) for f, m in maps.items() for top, p in ((0, m[:2]), (2, m[2:])) if p.size]
    cut = spark.createDataFrame(parts, "frame int, height int, width int, labels array<int>, top int").repartition(4)
    assert as_set(S.dense_class_stats(cut)) == as_set(S.class_stats(rows))
    plan = S.dense_class_stats(dense)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert "Exchange" not in S.dense_boundary(dense)._jdf.queryExecution().executedPlan().toString()


def test_full_size_maps_are_quick(spark):
    """Fifty maps of 896 x 896 pixels would be 40 million pixel rows."""
    dense = spark.range(50).selectExpr("id AS frame", "896 AS height", "896 AS width", "transform(sequence(0, 896 * 896 - 1), i -> int(i div (100 * 896 + id) % 7)) AS labels").repartition(8)
    began = time.time()
    assert S.dense_class_stats(dense).agg(F.sum("n_pixels")).first()[0] == 50 * 896 * 896
    assert S.dense_boundary(dense).select(F.sum(F.size("is_boundary").cast("long"))).first()[0] == 50 * 896 * 896
    assert time.time() - began < 120


def test_ranks_without_a_task_that_sees_all(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("rank_")).repartition(5)
    ranks = ranked(df, F.desc("k"))
    assert ranks.columns == ["k", "rank_", "rank"]
    assert [r.rank for r in ranks.orderBy(F.desc("k")).collect()] == list(range(1, 5001))
    assert "SinglePartition" not in ranks._jdf.queryExecution().executedPlan().toString() and ranked(df.limit(0), F.col("k")).count() == 0


def test_resize_maps_centres_and_clamps():
    assert np.allclose(S.resize(np.array([[0.0, 4.0]], np.float32), 1, 4), [[0, 1, 3, 4]])
    assert np.allclose(S.resize(np.arange(16, dtype=np.float32).reshape(4, 4), 4, 4), np.arange(16).reshape(4, 4))
    assert np.allclose(S.resize(np.array([[1.0, 3.0], [5.0, 7.0]], np.float32), 1, 1), [[4.0]])


def test_resized_column(spark):
    q = spark.createDataFrame([(0, 0, [1.0], [0.0, 4.0], 1, 2)], QUERY).withColumns({"height": F.lit(1), "width": F.lit(4)})
    row = S.resized(q).first()
    assert row.mask == [0.0, 1.0, 3.0, 4.0] and (row.mask_h, row.mask_w) == (1, 4)


def test_diagnostics(spark):
    q = spark.createDataFrame([(0, i, [float(i), 0.0, 0.0], [0.0, 2.0], 1, 2) for i in range(12)], QUERY)
    top = diagnostics.top_classes(q, 2).filter("query = 0").orderBy("rank").collect()
    assert [(r["class"], r["rank"]) for r in top] == [(0, 1), (1, 2)]
    stats = diagnostics.mask_stats(q)
    assert stats.count() == 10 and stats.first().area_native == 1 and stats.first().mask_mean == 1.0
    valid = S.valid_queries(q)
    assert [r.query for r in diagnostics.top_queries(valid, 2).collect()] == [11, 10]
    assert diagnostics.counts(q, valid, valid.limit(0)).first().asDict() == {"frame": 0, "n_queries": 12, "n_valid": valid.count(), "n_kept": 0}


def test_colours_and_blend(spark):
    palette = rendering.colours()
    assert len(palette) == 150 and palette == rendering.colours() and all(0.7 <= max(c[1:]) < 1.0 for c in palette)
    labels = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 149), (0, 0, 2, 500)], "frame int, y int, x int, label int")
    painted = rendering.coloured(labels, rendering.palette(spark)).orderBy("x")
    rows = [(r.r, r.g, r.b) for r in painted.collect()]
    assert rows[0] == rows[2] == (0, 0, 0) and rows[1] == tuple(int(c * 255) for c in palette[149][1:])
    image = labels.select("frame", "y", "x", *(F.lit(101).alias(c) for c in "rgb"))
    assert rendering.blended(image, painted).filter("x = 0").first().r == 50

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions.names import ADE20K, COCO, ade20k_name, coco_name, dimension
from framewright.operators import detection as D
from framewright.plans import sinks
from framewright.streaming import detections as stream

RAW = stream.RAW
BOX = [0.0, 1.0, 2.0, 3.0]


def raw(spark, *frames):
    return spark.createDataFrame(frames, RAW)


def kept(spark, *frames, **options):
    return {r.frame: [(x.ordinal, round(x.score, 4), x.category_id) for x in r.records] for r in D.detections(raw(spark, *frames), **options).collect()}


def test_threshold_is_inclusive_in_float32_and_nan_never_passes(spark):
    found = kept(spark, ("a", [BOX] * 4, [0.7, 0.69, math.nan, 0.9], [1, 2, 3, 4]), threshold=0.7)
    assert found == {"a": [(0, 0.7, 1), (3, 0.9, 4)]}


def test_no_boxes_give_an_empty_array_and_missing_arrays_no_row(spark):
    frames = [("none", [], [], []), ("bad", None, [0.9], [1]), ("low", [BOX], [0.1], [1])]
    assert kept(spark, *frames) == {"none": [], "low": []}
    assert [r.frame for r in D.rejected(raw(spark, *frames)).collect()] == ["bad"]
    ranges = {r.frame: r.min_label for r in D.label_range(raw(spark, *frames)).collect()}
    assert ranges["none"] is None and ranges["low"] == 1


def test_order_is_kept_up_to_k_and_sorted_with_ties_by_position_beyond(spark):
    scores = [0.5, 0.9, 0.5, 0.9]
    frame = ("a", [BOX] * 4, scores, [1, 2, 3, 4])
    assert [x[0] for x in kept(spark, frame, most=4)["a"]] == [0, 1, 2, 3]
    assert [x[0] for x in kept(spark, frame, most=3)["a"]] == [1, 3, 0]


def test_unequal_arrays_count_as_the_shortest(spark):
    assert len(kept(spark, ("a", [BOX], [0.9, 0.8], [1, 2, 3]))["a"]) == 1


def test_names(spark):
    assert len(COCO) == 80 and len(ADE20K) == 150 == len(set(ADE20K))
    ids = spark.createDataFrame([(i,) for i in (-1, 0, 1, 80, 81, 149, 150)], "id long")
    found = {r.id: (r.c, r.a) for r in ids.select("id", coco_name(F.col("id")).alias("c"), ade20k_name(F.col("id")).alias("a")).collect()}
    assert [found[i][0] for i in (-1, 0, 1, 80, 81)] == ["class_-1", "person", "person", "toothbrush", "class_81"]
    assert [found[i][1] for i in (0, 149, 150)] == ["wall", "flag", "class_150"]
    assert dimension(spark, COCO).count() == 80


# The names as their data sets list them.
COCO_NAMES = """
person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench, bird, cat, dog, horse, sheep, cow,
elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard,
tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, couch, potted plant, bed,
dining table, toilet, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush
"""
ADE_NAMES = """
wall, building, sky, floor, tree, ceiling, road, bed, windowpane, grass, cabinet, sidewalk, person, earth, door, table, mountain, plant, curtain, chair, car, water, painting, sofa, shelf, house, sea, mirror,
rug, field, armchair, seat, fence, desk, rock, wardrobe, lamp, bathtub, railing, cushion, base, box, column, signboard, chest of drawers, counter, sand, sink, skyscraper, fireplace, refrigerator,
grandstand, path, stairs, runway, case, pool table, pillow, screen door, stairway, river, bridge, bookcase, blind, coffee table, toilet, flower, book, hill, bench, countertop, stove, palm, kitchen island,
computer, swivel chair, boat, bar, arcade machine, hovel, bus, towel, light, truck, tower, chandelier, awning, streetlight, booth, television, airplane, dirt track, apparel, pole, land, bannister,
escalator, ottoman, bottle, buffet, poster, stage, van, ship, fountain, conveyer belt, canopy, washer, plaything, swimming pool, stool, barrel, basket, waterfall, tent, bag, minibike, cradle, oven, ball,
food, step, tank, trade name, microwave, pot, animal, bicycle, lake, dishwasher, screen, blanket, sculpture, hood, sconce, vase, traffic light, tray, ashcan, fan, pier, crt screen, plate, monitor,
bulletin board, shower, radiator, glass, clock, flag
"""


def test_names_are_those_of_the_data_sets():
    assert list(COCO) == [x.strip() for x in COCO_NAMES.replace("\n", " ").split(",")]
    assert list(ADE20K) == [x.strip() for x in ADE_NAMES.replace("\n", " ").split(",")]


def test_json_is_written_for_every_frame(spark, tmp_path):
    found = D.detections(raw(spark, ("/x/a.png", [BOX], [0.75], [3]), ("/x/b.png", [], [], [])))
    docs = {r.frame: json.loads(r.json) for r in D.documents(found).collect()}
    assert docs["/x/a.png"] == [{"bbox_xyxy": BOX, "score": 0.75, "category_id": 3, "category_name": "car"}] and docs["/x/b.png"] == []
    assert sinks.detection_file('[{"a":"é"}]') == '[\n  {\n    "a": "é"\n  }\n]'
    sinks.write_detections(found, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    frames = raw(spark, ("a", [BOX] * 2, [0.9, 0.4], [1, 2]), ("b", [], [], []))
    frames.write.parquet(f"file://{tmp_path}/in")
    query = stream.start(stream.read(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    query.awaitTermination(120)
    out = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r.frame, r.ordinal, r.category_name) for r in out] == [("a", 0, "person")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores=st.lists(st.sampled_from([0.1, 0.5, 0.6, 0.9, math.nan]), max_size=9), most=st.integers(1, 6))
def test_top_k_like_plain_python(spark, scores, most):
    ok = [(i, s) for i, s in enumerate(scores) if s >= 0.5]
    if len(ok) > most:
        ok = sorted(ok, key=lambda x: (-x[1], x[0]))[:most]
    found = kept(spark, ("a", [BOX] * len(scores), scores, [1] * len(scores)), most=most)
    assert [x[0] for x in found["a"]] == [i for i, _ in ok]


@pytest.mark.parametrize("size", [(1, 1), (2, 3)])
def test_png_reads_back(spark, tmp_path, size):
    from framewright.sources import images

    labels = np.arange(size[0] * size[1], dtype=np.uint8).reshape(size)
    (tmp_path / "a.png").write_bytes(sinks.png(labels))
    back = {(r.y, r.x): r.g for r in images.pixels(images.frames(spark, f"file://{tmp_path}")).collect()}
    assert back == {(y, x): int(labels[y, x]) for y in range(size[0]) for x in range(size[1])}

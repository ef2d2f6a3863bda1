"""From images to result files, with small models in place of the real ones."""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from fractions import Fraction
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.operators import detection, inference, parameters, rendering, segmentation
from framewright.plans import files, sinks
from framewright.plans import inference as program
from framewright.plans.files import report as files_report
from framewright.sources import images

SIZE = 4


def load_checkpoint(path):
    if not open(path, "rb").read().startswith(b"good"):
        raise ValueError("not a checkpoint")


def noted(folder, kind, lines):
    """Leaves a file below `folder`, as workers can't tell the test otherwise."""
    (Path(folder) / f"{kind}-{os.getpid()}-{uuid.uuid4().hex}").write_text("\n".join(lines))


def notes(folder, kind):
    return [(p.name.split("-")[1], p.read_text().split("\n")) for p in Path(folder).glob(f"{kind}-*")]


def load_detector(repo, backbone, adapter, device):
    """A box for each pixel of the first channel that is over 0.5, its value as score. Images named null and silent get no boxes and no row,
    images named fatal end the run. Loads and images are noted in the folder `repo`."""
    noted(repo, "loaded", [adapter])
    if adapter == "broken":
        raise OSError("no such adapter")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        noted(repo, "detected", batch.frame)
        if batch.frame.str.contains("fatal").any():
            raise RuntimeError("the model fails")
        batch = batch[~batch.frame.str.contains("silent")]
        rows = []
        for r in batch.itertuples():
            red = np.asarray(r.input, np.float32).reshape(3, r.height, r.width)[0].ravel()
            boxes = None if "null" in r.frame else [[i + 0.1, 0.0, i + 1.0, 1.0] for i in range(len(red))]
            rows.append((r.frame, boxes, red.tolist(), [k % 90 for k in range(len(red))]))
        return pd.DataFrame(rows, columns=["frame", "boxes", "scores", "labels"])

    return model


def load_segmentor(repo, backbone, adapter, device):
    """Query 0 is class 3 where the first channel is over its mean, query 1 is background, query 2 class 5 nowhere."""
    noted(repo, "loaded", [adapter])

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        noted(repo, "segmented", batch.frame)
        rows = []
        for r in batch.itertuples():
            red = np.asarray(r.input, np.float32).reshape(3, SIZE, SIZE)[0]
            logits = np.zeros((3, 7), np.float32)
            logits[[0, 1, 2], [3, 6, 5]] = 9
            masks = np.stack([10 * (red - red.mean()), np.ones_like(red), -np.ones_like(red)]).reshape(3, -1)
            rows.append((r.frame, r.height, r.width, logits.tolist(), masks.tolist(), SIZE, SIZE))
        return pd.DataFrame(rows, columns=["frame", "height", "width", "logits", "masks", "mask_h", "mask_w"])

    return model


def unpacked(content: bytes) -> np.ndarray:
    """Samples of a PNG that `sinks.png` wrote."""
    width, height, kind = (int.from_bytes(content[a:b]) for a, b in ((16, 20), (20, 24), (25, 26)))
    size = int.from_bytes(content[33:37])
    raster = np.frombuffer(zlib.decompress(content[41 : 41 + size]), np.uint8).reshape(height, -1)
    return raster[:, 1:].reshape((height, width) if kind == 0 else (height, width, 3))


@pytest.fixture
def pictures(tmp_path):
    """Two pictures of 16 x 12: the first one's left half is red on grey, the second is of one colour. One more has the stem of the first."""
    folder = tmp_path / "in"
    (folder / "z").mkdir(parents=True)
    left = np.full((16, 12, 3), 90, np.uint8)
    left[:, :6] = (255, 10, 10)
    (folder / "left.png").write_bytes(sinks.png(np.full((2, 2, 3), 7)))
    (folder / "z" / "left.png").write_bytes(sinks.png(left))
    (folder / "plain.png").write_bytes(sinks.png(np.full((16, 12, 3), 8)))
    return folder, left


def test_shrunk_like_the_definition():
    image = np.random.default_rng(2).integers(0, 256, (11, 7)).astype(np.uint8)

    def weights(n, m, i):
        scale = Fraction(n, m)
        reach = max(scale, Fraction(1))
        w = [max(Fraction(0), 1 - abs(k + Fraction(1, 2) - (i + Fraction(1, 2)) * scale) / reach) for k in range(n)]
        return [x / sum(w) for x in w]

    for h, w in ((4, 3), (11, 7), (16, 9), (1, 1)):
        found = images.shrunk(image, h, w)
        rows, columns = np.array([weights(11, h, i) for i in range(h)], float), np.array([weights(7, w, j) for j in range(w)], float)
        want = rows @ image.astype(float) @ columns.T
        assert np.abs(found - want).max() <= 0.5 + 1e-9


def test_model_inputs(spark, pictures):
    folder, left = pictures
    found = images.frames(spark, str(folder)).filter("frame LIKE '%z/left.png'")
    plain, sized = images.model_frames(found).first(), images.model_frames(found, SIZE).first()
    assert (plain.height, plain.width) == (sized.height, sized.width) == (16, 12)
    assert np.allclose(np.reshape(plain.input, (3, 16, 12)), left.transpose(2, 0, 1) / 255)
    corner = np.reshape(sized.input, (3, SIZE, SIZE))[:, 0, 0]
    assert np.allclose(corner, [(255 / 255 - 0.485) / 0.229, (10 / 255 - 0.456) / 0.224, (10 / 255 - 0.406) / 0.225], atol=1e-5)


def test_segment_paints_every_frame(spark):
    logits = [[0.0, 9.0, 0.0], [0.0, 0.0, 9.0], [9.0, 0.0, 0.0], [9.0, 0.0, 0.0]]
    masks = [[1.0, -1.0], [5.0, 5.0], [-1.0, -1.0], [2.0, -3.0]]
    rows = [("a", 2, 4, logits, masks, 1, 2), ("b", 1, 1, [], [], 1, 2), ("c", 1, 1, None, masks, 1, 2), ("d", 1, 2, logits[1:2], masks[1:2], 1, 2)]
    raw = spark.createDataFrame(rows, inference.SEGMENTOR)
    found = {r.frame: r for r in segmentation.segment(raw, 3).collect()}
    assert sorted(found) == ["a", "b", "d"] and [r.frame for r in segmentation.rejected(raw).collect()] == ["c"]
    # query 0 covers half (4 pixels), query 2 none, query 3 the left too and with more weight
    assert [(q.query, q["class"], q.area) for q in found["a"].queries] == [(0, 1, 4), (3, 0, 4)] and not found["b"].queries and not found["d"].queries
    assert found["b"].labels == [0] and found["d"].labels == [0, 0]
    mask = np.array([[1.0, -1.0]], np.float32), np.array([[2.0, -3.0]], np.float32)
    w = [1 / (1 + np.exp(-segmentation.resize(m, 2, 4).astype(float))) for m in mask]
    assert np.array_equal(np.reshape(found["a"].labels, (2, 4)), np.where(w[0] >= w[1], 1, 0))
    report = segmentation.query_report(segmentation.segment(raw, 3)).collect()
    assert [(r.frame, r.query, r.prob, r.area) for r in report] == [("a", 0, "1.000", 4), ("a", 3, "1.000", 4)]
    pixels = segmentation.map_pixels(segmentation.segment(raw, 3)).filter("frame = 'a'").orderBy("y", "x").collect()
    assert [r.label for r in pixels] == found["a"].labels and (pixels[-1].y, pixels[-1].x) == (1, 3)


def test_captions(spark):
    raw = spark.createDataFrame([("a", [[0.0, 0.0, 1.0, 1.0]], [0.875], [1])], inference.DETECTOR)
    assert [r.caption for r in detection.captions(detection.detections(raw)).collect()] == ["person: 0.88"]


@pytest.fixture
def run(spark, pictures, tmp_path, monkeypatch):
    """The program over the pictures with the small models; what it returns and the files it leaves."""
    folder, _ = pictures
    models = SimpleNamespace(load_checkpoint=load_checkpoint, load_detector=load_detector, load_segmentor=load_segmentor)
    monkeypatch.setitem(sys.modules, "small_models", models)
    (tmp_path / "backbone.pth").write_bytes(b"good")
    (tmp_path / "notes").mkdir()

    def program_run(*more, backbone="backbone.pth", out="out"):
        common = ["--repo", str(tmp_path / "notes"), "--input", str(folder), "--output", str(tmp_path / out), "--models", "small_models", "--image-size", str(SIZE), "--max-detections", "5"]
        code = program.main([*common, "--backbone", str(tmp_path / backbone), *more], spark)
        return code, {str(p.relative_to(tmp_path / out)): p for p in (tmp_path / out).rglob("*") if p.is_file() and p.parent.name != "_report" and not p.name.endswith(".crc")}

    yield program_run, folder, tmp_path, models
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


BOTH = ("--task", "both", "--detection-adapter", "d", "--segmentation-adapter", "s")


@pytest.mark.parametrize("visuals", [True, False])
def test_program_writes_every_file_and_shows_each_image_once(spark, pictures, run, visuals, caplog):
    start, folder, home, _ = run
    left = pictures[1]
    assert start(*BOTH, backbone="missing.pth")[0] == 1
    with caplog.at_level("INFO"):
        code, files = start(*BOTH, *["--save-visuals"] * visuals)
    assert code == 0
    more = ["detection/left_detection_overlay.png", "segmentation/left_mask_only.png", "segmentation/left_overlay.png"] if visuals else []
    assert sorted(files) == sorted(["detection/left_detections.json", "detection/plain_detections.json", "segmentation/left_segmentation.png", "segmentation/plain_segmentation.png", *more])
    records = json.loads(files["detection/left_detections.json"].read_text())
    assert len(records) == 5 and {r["score"] for r in records} == {1.0} and records[0]["bbox_xyxy"][0] == float(np.float32(0.1))
    assert files["detection/plain_detections.json"].read_text() == "[]"
    seg = {n: unpacked(p.read_bytes()) for n, p in files.items() if n.endswith(".png")}
    labels = seg["segmentation/left_segmentation.png"]
    assert labels.shape == (16, 12) and (labels == 3).all() and not seg["segmentation/plain_segmentation.png"].any()
    if visuals:
        mask = seg["segmentation/left_mask_only.png"]
        assert mask[0, 0].any() and (mask == mask[0, 0]).all() and (seg["segmentation/left_overlay.png"] == (left.astype(int) + mask) // 2).all()
        assert (seg["detection/left_detection_overlay.png"] == rendering.outlined(left, [r["bbox_xyxy"] for r in records])).all()
    for kind in ("detected", "segmented"):
        shown = [f for _, frames in notes(home / "notes", kind) for f in frames]
        assert len(shown) == len(set(shown)) == 3
    report = {r.frame.split("/in/")[1]: json.loads(r.report) for r in files_report(str(home / "out/segmentation"), spark).collect()}
    assert report["z/left.png"] | {"queries": 0} == {"n_valid": 2, "n_kept": 1, "n_labels": 1, "coverage_pct": "100.0", "queries": 0} and report["z/left.png"]["queries"][0]["name"] == "floor"
    assert report["plain.png"]["n_labels"] == 0 and len(report) == 3
    assert "detection: 3 frames, 388 raw, 5 kept, 0 least label, 89 largest label" in caplog.text and "1 labels, 33.3" in caplog.text
    with pytest.raises(ValueError):
        start("--task", "detection")


def test_program_loads_a_model_once_a_worker(run):
    start, folder, home, models = run
    for k in range(12):
        (folder / f"more{k}.png").write_bytes(sinks.png(np.full((4, 4, 3), 200)))
    for again in range(3):
        assert start("--task", "detection", "--detection-adapter", "d")[0] == 0
    loads = [pid for pid, _ in notes(home / "notes", "loaded")]
    assert len(loads) == len(set(loads)) and len(notes(home / "notes", "detected")) > len(loads)


def test_program_tries_the_fallback(run):
    start, _, home, models = run
    with pytest.raises(Exception, match="no such adapter"):
        start("--task", "detection", "--detection-adapter", "broken")
    models.load_detector_otherwise = lambda repo, backbone, adapter, device: load_detector(repo, backbone, "other", device)
    code, files = start("--task", "detection", "--detection-adapter", "broken")
    assert code == 0 and len(files) == 2 and ["other"] in [x for _, x in notes(home / "notes", "loaded")]


def test_program_reports_what_it_cannot_read(spark, run, caplog):
    start, folder, home, _ = run
    whole = (folder / "plain.png").read_bytes()
    (folder / "a b+c%20é.png").write_bytes(whole)
    (folder / "text.png").write_text("no image")
    (folder / "empty.png").write_bytes(b"")
    noise = sinks.png(np.random.default_rng(1).integers(0, 255, (64, 64, 3)).astype(np.uint8))
    for k, end in enumerate((45, len(noise) // 2)):
        (folder / f"cut{k}.png").write_bytes(noise[:end])
    (folder / "null.png").write_bytes(whole)
    (folder / "silent.png").write_bytes(whole)
    code, files = start("--task", "detection", "--detection-adapter", "d")
    assert code == 2 and sorted(files) == ["a b+c%20é_detections.json", "left_detections.json", "plain_detections.json"]
    reasons = {r.frame.split("/")[-1]: r.reason for r in files_report(str(home / "out"), spark).filter("reason IS NOT NULL").collect()}
    assert {reasons.pop(f"cut{k}.png") for k in range(2)} <= {"no image that can be decoded", "can't be read or decoded"}
    assert reasons == {"empty.png": "can't be read or decoded", "text.png": "no image that can be decoded", "null.png": "the model's output lacks boxes or scores or labels", "silent.png": "the model gave nothing"}
    assert "6 frames have no result" in caplog.text


def test_program_that_fails_leaves_nothing(run):
    start, folder, home, _ = run
    (folder / "fatal.png").write_bytes((folder / "plain.png").read_bytes())
    with pytest.raises(Exception, match="the model fails"):
        start("--task", "detection", "--detection-adapter", "d")
    assert not [p for p in (home / "out").rglob("*") if p.is_file()] and not list((home / "out").glob(".staging*"))


def test_failed_tasks_leave_no_folder(tmp_path):
    writer = files._Writer(str(tmp_path / "staging"))

    def rows():
        yield pa.RecordBatch.from_pylist([{"frame": "a", "files": [{"ending": ".x", "content": b"1"}], "reason": None, "report": None}])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert not list((tmp_path / "staging").iterdir())


def test_files_of_equal_stems_come_from_the_last_that_has_them(spark, tmp_path):
    rows = [("/a/i.png", [("_x", b"1"), ("_y", b"1")], None, "r"), ("/b/i.png", [("_x", b"2")], None, None), ("/a-b/i.png", None, "broken", None), ("/a/j", [], None, None)]
    results = spark.createDataFrame(rows, files.RESULT).repartition(3)
    listed = spark.createDataFrame([("/a/i.png",), ("/z.png",)], "path string")
    done = files.write_frames(results, str(tmp_path / "out"), listed)
    assert (done.files, done.rejected) == (2, 2)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.is_file()} == {"i_x": b"2", "i_y": b"1"}
    assert sorted((r.frame, r.reason, r.report) for r in files.report(str(tmp_path / "out"), spark).collect())[-1] == ("/z.png", files.UNREAD, None)
    assert files.write_frames(results.limit(0), str(tmp_path / "none")).files == 0


def test_placement():
    profile = inference.placement(4, 2, "9g")
    assert profile.taskResources["gpu"].amount == 1 and profile.taskResources["cpus"].amount == 2
    assert profile.executorResources["gpu"].amount == 4 and profile.executorResources["cores"].amount == 8


def test_outlines_like_painting_pixel_by_pixel():
    draw = np.random.default_rng(5)
    for _ in range(60):
        h, w = draw.integers(1, 14, 2)
        image = draw.integers(0, 255, (h, w, 3)).astype(np.uint8)
        boxes = [[*(a := draw.uniform(-6, 15, 2)), *(a + draw.uniform(0, 12, 2))] for _ in range(3)] + [[5, 5, 2, 2], [float("nan")] * 4, [-1e12, 1, 1e12, 3]]
        want = image.copy()
        for x1, y1, x2, y2 in boxes[:3] + boxes[5:]:
            x1, y1, x2, y2 = int(x1), int(y1), int(x2), int(y2)
            for y in range(h):
                for x in range(w):
                    if x1 <= x <= x2 and y1 <= y <= y2 and min(x - x1, x2 - x, y - y1, y2 - y) < 3:
                        want[y, x] = (255, 0, 0)
        assert (rendering.outlined(image, boxes) == want).all()


def test_checkpoints(spark, tmp_path):
    good, bad, small = tmp_path / "a.pth", tmp_path / "b.pth", tmp_path / "x_lvd1689m.pth"
    good.write_bytes(b"good")
    bad.write_bytes(b"bad")
    small.write_bytes(b"good")
    rows = [parameters.verify(spark, str(p), load_checkpoint).first() for p in (good, bad, small, tmp_path / "none.pth")]
    assert [(r.found, r.loads, r.reason, r.is_complete) for r in rows] == [(True, True, None, True), (True, False, "not a checkpoint", False), (True, False, "too small", False), (False, False, "no such file", False)]
    params = spark.createDataFrame([(0, "head.weight", True, [150, 4], "float32"), (1, "blocks.0.w", True, [4], "float32")], "ordinal int, key string, is_tensor boolean, shape array<bigint>, dtype string")
    reports = parameters.report(params, params.select("ordinal", F.lit("epoch").alias("key")), "segmentation")
    assert reports["heads"].first().dataset == "ADE20K" and reports["modules"].count() == 2 and reports["backbone_keys"].first().key == "blocks.0.w" and reports["metadata"].count() == 2


def test_label_folders_are_bounded(spark, tmp_path):
    labels = spark.range(60).selectExpr("concat('f', id) AS frame", "0 AS y", "0 AS x", "1 AS label")
    sinks.write_labels(labels, f"file://{tmp_path}/labels", 4)
    assert len([p for p in (tmp_path / "labels").iterdir() if p.is_dir()]) <= 4 and spark.read.parquet(f"file://{tmp_path}/labels").count() == 60

"""Results as they go out: tables by frame, JSON documents, and the files of each frame."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.names import ade20k_name
from framewright.functions.tensors import shown
from framewright.operators.detection import named
from framewright.operators.rendering import colours, outlined
from framewright.sources.images import rgb, samples

#: Folders of a label map's table.
FOLDERS = 256


def write_detections(found: DataFrame, path: str) -> None:
    """One JSON line a frame, (frame, detections), also for frames without detections."""
    found.select("frame", named("records").alias("detections")).write.mode("overwrite").json(path)


def detection_file(record_json: str) -> str:
    """A frame's records as its JSON file has them: indented by 2, characters unescaped."""
    return json.dumps(json.loads(record_json), indent=2, ensure_ascii=False)


def write_labels(labels: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """The label map as Parquet in at most `folders` folders (bucket) by a frame's hash, so that their number doesn't grow with the frames."""
    held = labels.withColumn("bucket", F.pmod(F.xxhash64("frame"), F.lit(folders)).cast("int"))
    held.repartition("bucket", "frame").sortWithinPartitions("bucket", "frame").write.mode("overwrite").partitionBy("bucket").parquet(path)


def png(samples: np.ndarray) -> bytes:
    """An 8-bit PNG: grey of a label map (height, width), colours of (height, width, 3)."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = samples.shape[:2]
    rows = samples.astype(np.uint8).reshape(height, -1)
    raster = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if samples.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raster)) + chunk(b"IEND", b"")


_FILES = pa.list_(pa.struct([("ending", pa.string()), ("content", pa.binary())]))
_FILES_DDL = "files array<struct<ending:string,content:binary>>"


def detection_files(found: DataFrame, visuals: bool = False) -> DataFrame:
    """Rows for `write_frames` from `inference.detect`'s: each frame's records as JSON, and with `visuals` (which takes height, width,
    channels and data along) its image with the boxes' outlines, if it has any. Captions aren't drawn. The report has the
    counts of detections and the range of labels before any filter. Everything of a frame is made from its one row."""
    seen = found.withColumn("json", F.to_json(named("records"))).withColumn("boxes", F.transform("records", lambda x: x["bbox_xyxy"]))
    report = F.to_json(F.struct("n_raw", "min_label", "max_label", F.size("records").alias("n_kept")))
    more = ["height", "width", "channels", "data", "boxes"] if visuals else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                files = None
                if not batch.column(1)[k].is_valid:
                    files = [{"ending": "_detections.json", "content": detection_file(batch.column(3)[k].as_py()).encode()}]
                    boxes = batch.column(8)[k].as_py() if visuals else []
                    if boxes:
                        image = np.stack(rgb(samples(batch, k)), axis=-1)
                        files.append({"ending": "_detection_overlay.png", "content": png(outlined(image, boxes))})
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:3], pa.array([files], _FILES)], ["frame", "reason", "report", "files"])

    known = seen.select("frame", "reason", F.when(F.col("reason").isNull(), report).alias("report"), "json", *more)
    return known.mapInArrow(run, f"frame {_kind(found)}, reason string, report string, {_FILES_DDL}")


def segmentation_files(found: DataFrame, visuals: bool = False) -> DataFrame:
    """Rows for `write_frames` from `inference.segment`'s: each frame's label map as PNG, and with `visuals` (which takes channels and
    data along), if it has a label but 0, the coloured map and half of it over half of the image. The report has the counts of
    valid and kept queries, of labels but 0, their share of the pixels in percent, and the kept queries, most probable first. Everything of a frame is made
    from its one row."""
    colour = np.zeros((256, 3), np.uint8)
    colour[1 : len(colours())] = [[int(c * 255) for c in rgb] for _, *rgb in colours()[1:]]
    listed = F.transform("queries", lambda q: F.struct((-q["fg_prob"]).alias("order"), q["query"].alias("query"), ade20k_name(q["class"]).alias("name"), shown(q["fg_prob"], 3).alias("prob"), q["area"].alias("area")))
    listed = F.transform(F.array_sort(listed), lambda q: q.dropFields("order"))
    pixels = F.size("labels")
    counts = {"n_kept": F.size("queries"), "n_labels": F.size(F.filter(F.array_distinct("labels"), lambda v: v != 0)), "covered": F.size(F.filter("labels", lambda v: v != 0))}
    seen = found.withColumns(counts).withColumn("coverage_pct", F.when(pixels > 0, F.col("covered") / pixels * 100).otherwise(0.0))
    report = F.to_json(F.struct("n_valid", "n_kept", "n_labels", shown(F.col("coverage_pct"), 1).alias("coverage_pct"), listed.alias("queries")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                files = None
                if not batch.column(1)[k].is_valid:
                    height, width = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                    labels = batch.column(5)[k].values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(height, width)
                    files = [{"ending": "_segmentation.png", "content": png(labels)}]
                    if visuals and labels.any():
                        image, masked = np.stack(rgb(samples(batch, k)), axis=-1), colour[labels]
                        half = ((image.astype(np.uint16) + masked) // 2).astype(np.uint8)
                        files += [{"ending": "_mask_only.png", "content": png(masked)}, {"ending": "_overlay.png", "content": png(half)}]
                row = batch.slice(k, 1)
                kept = [row.column(row.schema.get_field_index(n)) for n in ("frame", "reason", "report", *measures)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([files], _FILES)], ["frame", "reason", "report", *measures, "files"])

    measures = ("n_valid", "n_kept", "n_labels", "coverage_pct")
    known = seen.select("frame", "reason", F.when(F.col("reason").isNull(), report).alias("report"), "height", "width", "labels", *measures, *(["channels", "data"] if visuals else []))
    return known.mapInArrow(run, f"frame {_kind(found)}, reason string, report string, n_valid int, n_kept int, n_labels int, coverage_pct double, {_FILES_DDL}")


def png_column(dense: DataFrame) -> DataFrame:
    """(frame, content): PNG bytes of dense label maps (frame, height, width, labels)."""

    def run(frames):
        for part in frames:
            part["content"] = [png(np.asarray(x).reshape(h, w)) for x, h, w in zip(part["labels"], part["height"], part["width"], strict=True)]
            yield part[["frame", "content"]]

    return dense.select("frame", "height", "width", "labels").mapInPandas(run, f"frame {_kind(dense)}, content binary")


def _kind(df: DataFrame) -> str:
    return df.schema["frame"].dataType.simpleString()


def report(df: DataFrame, rows: int = 30) -> None:
    """Print a report as a table."""
    df.show(rows, truncate=False)

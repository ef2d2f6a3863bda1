"""The slot for a model: a function from images to outputs, given from outside, loaded once a worker and run on Arrow batches."""

from __future__ import annotations

import hashlib
import logging
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.operators import detection, segmentation
from framewright.sources.images import model_frames

LOG = logging.getLogger("framewright")
Batch = Callable[[pd.DataFrame], pd.DataFrame]

#: Models that a worker holds; the one used longest ago goes first.
HELD = 2
_HELD: OrderedDict[str, Batch] = OrderedDict()


@dataclass(frozen=True)
class Model:
    """How a worker gets a model: load(*arguments) returns the function from images to outputs. If that raises, fallback(*arguments) is tried."""

    load: Callable[..., Batch]
    arguments: tuple = ()
    fallback: Callable[..., Batch] | None = None

    def key(self) -> str:
        return hashlib.sha256(cloudpickle.dumps((self.load, self.arguments, self.fallback))).hexdigest()

    def loaded(self) -> Batch:
        try:
            return self.load(*self.arguments)
        except Exception as problem:
            if self.fallback is None:
                raise
            LOG.warning("%s fails (%s), the fallback is tried", getattr(self.load, "__name__", self.load), problem)
            return self.fallback(*self.arguments)


def held(key: str, model: Model) -> Batch:
    """The model of this worker process. Workers live on from task to task (spark.python.worker.reuse), so it is loaded once a process, not once a task."""
    if key not in _HELD:
        while len(_HELD) >= HELD:
            _HELD.popitem(last=False)  # before the next one is loaded: both may not fit
        _HELD[key] = model.loaded()
    _HELD.move_to_end(key)
    return _HELD[key]


def placement(gpus: int = 1, cores: int = 1, memory: str | None = None) -> ResourceProfile:
    """Executors for a model: so many GPUs each, one of them and `cores` cores a task, so that as many workers hold the model as there are GPUs."""
    executor, task = ExecutorResourceRequests().cores(cores * max(gpus, 1)), TaskResourceRequests().cpus(cores)
    if gpus:
        executor, task = executor.resource("gpu", gpus), task.resource("gpu", 1)
    if memory:
        executor = executor.pysparkMemory(memory)
    return ResourceProfileBuilder().require(executor).require(task).build


def infer(rows: DataFrame, model: Model | Callable[[], Batch], schema: str, profile: ResourceProfile | None = None) -> DataFrame:
    """Apply a model to batches of any rows. Models never run on the driver; profile places them."""
    model = model if isinstance(model, Model) else Model(model)
    key = model.key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = held(key, model)
        for batch in batches:
            yield use(batch)

    return rows.mapInPandas(run, schema, profile=profile)


def outcomes(frames: DataFrame, model: Model | Callable[[], Batch], schema: str, carry: Sequence[str] = (), profile: ResourceProfile | None = None) -> DataFrame:
    """Apply a model to batches of frames (frame, height, width, input): rows of `schema`, then the columns `carry` of the frame, then `reason`.

    A frame with a null input isn't shown to the model; its reason, if it has that column, stays. A frame for which the model gives no
    row has nulls and a reason.
    """
    model = model if isinstance(model, Model) else Model(model)
    key, names = model.key(), StructType.fromDDL(schema).names
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in carry)
    known = "reason" in frames.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = held(key, model)
        for batch in batches:
            shown = batch.loc[batch["input"].notna(), ["frame", "height", "width", "input"]].astype({"height": "int32", "width": "int32"})
            found = (use(shown) if len(shown) else pd.DataFrame(columns=names))[names].drop_duplicates("frame").set_index("frame")
            out = found.reindex(batch["frame"]).astype(object)
            out = out.where(out.notna(), None).reset_index()
            for c in carry:
                out[c] = batch[c].to_numpy()
            own = batch["reason"] if known else pd.Series([None] * len(batch), index=batch.index, dtype=object)
            out["reason"] = [r if isinstance(r, str) else None if f in found.index else "the model gave nothing" for r, f in zip(own, batch["frame"], strict=True)]
            yield out[[*names, *carry, "reason"]]

    return frames.mapInPandas(run, ", ".join(x for x in (schema, kinds, "reason string") if x), profile=profile)


# The columns that models give for each frame. A null array marks an output that can't be read.
DETECTOR = "frame string, boxes array<array<float>>, scores array<float>, labels array<bigint>"
SEGMENTOR = "frame string, height int, width int, logits array<array<float>>, masks array<array<float>>, mask_h int, mask_w int"


def lacking(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the reason why their output can't be read, and empty arrays there."""
    null = F.lit(False)
    for n in names:
        null = null | F.col(n).isNull()
    reason = F.coalesce("reason", F.when(null, F.lit("the model's output lacks " + " or ".join(names))))
    return raw.withColumns({"reason": reason, **{n: F.when(reason.isNull(), F.col(n)).otherwise(F.array().cast(raw.schema[n].dataType)) for n in names}})


def detect(images: DataFrame, model: Model | Callable[[], Batch], threshold: float = detection.THRESHOLD, most: int = detection.MOST, carry: Sequence[str] = (), profile: ResourceProfile | None = None) -> DataFrame:
    """(frame, n_raw, records, min_label, max_label, carry, reason) of images by a detector that takes (frame, height, width, input) and gives DETECTOR; see `detections`.

    One row for each image. Images that couldn't be decoded (`images.decoded`) and outputs that can't be read have a reason and no records.
    """
    raw = outcomes(model_frames(images, None, [*carry, *_reason(images)]), model, DETECTOR, carry, profile)
    return detection.detections(lacking(raw, ("boxes", "scores", "labels")), threshold, most, [F.array_min("labels").alias("min_label"), F.array_max("labels").alias("max_label"), *carry, "reason"])


def segment(images: DataFrame, model: Model | Callable[[], Batch], size: int = 896, least: int = segmentation.LEAST_AREA, carry: Sequence[str] = (), profile: ResourceProfile | None = None) -> DataFrame:
    """(frame, height, width, labels, queries, n_valid, carry, reason) of images by a segmentor that takes inputs of size x size and gives SEGMENTOR; see `segmentation.segment`.

    One row for each image. Images that couldn't be decoded and outputs that can't be read have a reason and no labels.
    """
    raw = lacking(outcomes(model_frames(images, size, [*carry, *_reason(images)]), model, SEGMENTOR, carry, profile), ("logits", "masks"))
    empty = {n: F.when(F.col("reason").isNull(), F.col(n)).otherwise(F.lit(0)) for n in ("height", "width", "mask_h", "mask_w")}
    return segmentation.segment(raw.withColumns(empty), least, [*carry, "reason"])


def _reason(images: DataFrame) -> list[str]:
    return ["reason"] if "reason" in images.columns else []

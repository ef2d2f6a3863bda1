"""Images to result files from the command line; models come from outside, as functions named module:function."""

from __future__ import annotations

import argparse
import importlib
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framewright.operators import inference, parameters
from framewright.plans import sinks
from framewright.plans.files import write_frames
from framewright.plans.runner import PARTS, check_adapters, output_folders
from framewright.shipping import ship
from framewright.sources import images

LOG = logging.getLogger("framewright")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Run detection and segmentation over images.")
    for name in ("--repo", "--backbone", "--input", "--output"):
        out.add_argument(name, required=True)
    out.add_argument("--task", required=True, choices=list(PARTS))
    for name in ("--detection-adapter", "--segmentation-adapter"):
        out.add_argument(name)
    out.add_argument("--device", default="cuda:0")
    out.add_argument("--confidence-threshold", type=float, default=0.5)
    out.add_argument("--max-detections", type=int, default=100)
    out.add_argument("--image-size", type=int, default=896)
    out.add_argument("--color-map", default="Spectral", help="accepted for old commands; colours are fixed")
    out.add_argument("--save-visuals", action="store_true", help="coloured maps and overlays beside the label maps")
    out.add_argument("--clear-cache", action="store_true", help="accepted for old commands; nothing is cached")
    out.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    out.add_argument("--gpus", type=int, default=0, help="GPUs of each executor, one for each task; 0 leaves placement to the session")
    out.add_argument("--models", required=True, metavar="MODULE", help="module with load_detector and load_segmentor (repo, backbone, adapter, device), each giving a batch function, and load_checkpoint (path); load_detector_otherwise and load_segmentor_otherwise, if there, are tried where loading fails")
    return out


#: Images that go to a worker, and to the model, together.
IMAGES = 8


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, 1 if the backbone isn't whole, or 2 if images or outputs couldn't be read: `_report` beside the files says which and why.

    Missing images, and a part of the work without its adapter, are errors. Each image goes through a model once.
    """
    p = parser().parse_args(arguments)
    logging.basicConfig(level=p.log_level)
    check_adapters(p.task, p.detection_adapter, p.segmentation_adapter)
    for name, value, usual in (("--color-map", p.color_map, "Spectral"), ("--clear-cache", p.clear_cache, False)):
        if value != usual:
            LOG.warning("%s has no effect", name)
    models = importlib.import_module(p.models)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    backbone = parameters.verify(spark, p.backbone, models.load_checkpoint).first()
    if not backbone.is_complete:
        LOG.error("%s: %s", p.backbone, backbone.reason)
        return 1
    listed, found = images.listing(spark, p.input), images.decoded(spark, p.input)
    detected, segmented = output_folders(p.task, p.output)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", IMAGES)
    profile = inference.placement(p.gpus) if p.gpus else None

    def model(kind: str, adapter: str) -> inference.Model:
        return inference.Model(getattr(models, f"load_{kind}"), (p.repo, p.backbone, adapter, p.device), getattr(models, f"load_{kind}_otherwise", None))

    rejected = 0
    if detected:
        records = inference.detect(found, model("detector", p.detection_adapter), p.confidence_threshold, p.max_detections, ["height", "width", "channels", "data"] if p.save_visuals else [], profile)
        sums = {"raw": F.sum("n_raw"), "kept": F.sum(F.size("records")), "least label": F.min("min_label"), "largest label": F.max("max_label")}
        rejected += _written("detection", detected, records, sums, lambda df: sinks.detection_files(df, p.save_visuals), listed)
    if segmented:
        labels = inference.segment(found, model("segmentor", p.segmentation_adapter), p.image_size, carry=["channels", "data"] if p.save_visuals else [], profile=profile)
        sums = {"valid queries": F.sum("n_valid"), "kept queries": F.sum(F.size("queries"))}
        shares = {"labels": F.sum("n_labels"), "mean coverage": F.avg(F.when(F.col("reason").isNull(), F.col("coverage_pct")))}
        rejected += _written("segmentation", segmented, labels, sums, lambda df: sinks.segmentation_files(df, p.save_visuals), listed, shares)
    LOG.info("done: %s", p.output)
    return 2 if rejected else 0


def _written(kind: str, folder: str, found: DataFrame, sums: dict[str, Column], files: Callable[[DataFrame], DataFrame], listed: DataFrame, later: dict[str, Column] | None = None) -> int:
    """Write one model's results and log their summary, which is gathered while they are written; the number of frames without a result."""
    seen, last = Observation(), Observation()
    count = F.count(F.lit(1)).alias("frames")
    results = files(found.observe(seen, count, *(v.alias(k) for k, v in sums.items())))
    results = results.observe(last, count, *(v.alias(k) for k, v in (later or {}).items()))
    done = write_frames(results, folder, listed)
    LOG.info("%s: %s, %d files", kind, ", ".join(f"{v} {k}" for k, v in (seen.get | last.get).items()), done.files)
    if done.rejected:
        LOG.error("%s: %d frames have no result, see %s/_report", kind, done.rejected, folder)
    return done.rejected


if __name__ == "__main__":
    raise SystemExit(main())

"""Detections from a detector's parallel arrays: threshold, top k, class names, JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.names import coco_name
from framewright.functions.tensors import at_least, shown

THRESHOLD, MOST = 0.5, 100
RECORD = "array<struct<ordinal:int,bbox_xyxy:array<float>,score:double,category_id:bigint>>"


def rejected(raw: DataFrame) -> DataFrame:
    """Frames whose output lacks one of its arrays; they give no detections."""
    return raw.filter("boxes IS NULL OR scores IS NULL OR labels IS NULL").select("frame")


def detections(raw: DataFrame, threshold: float = THRESHOLD, most: int = MOST, carry: Sequence[Column | str] = ()) -> DataFrame:
    """(frame, n_raw, records, carry): each frame's kept detections as an array, one row in and one out, so nothing is shuffled.

    Arrays of unequal length count as long as the shortest. A score is kept from the threshold on, compared
    as float32; NaN never is. Only if more than `most` are left are they sorted, by falling score, ties
    by position, and cut; otherwise they keep their order. Frames without boxes have an empty array. Columns
    of `carry` go along.
    """
    size = F.least(F.size("boxes"), F.size("scores"), F.size("labels"))
    zipped = F.arrays_zip(F.sequence(F.lit(1), size).alias("i"), F.slice("boxes", 1, size).alias("b"), F.slice("scores", 1, size).alias("s"), F.slice("labels", 1, size).alias("l"))
    records = F.when(size > 0, F.transform(zipped, lambda x: F.struct((x["i"] - 1).alias("ordinal"), x["b"].alias("bbox_xyxy"), x["s"].alias("score"), x["l"].cast("bigint").alias("category_id")))).otherwise(F.array())
    kept = raw.filter("boxes IS NOT NULL AND scores IS NOT NULL AND labels IS NOT NULL")
    kept = kept.select("frame", F.size("scores").cast("long").alias("n_raw"), F.filter(records.cast(RECORD.replace("score:double", "score:float")), lambda x: at_least(x["score"], threshold)).alias("r"), F.struct(F.lit(0).alias("_"), *carry).alias("c"))
    order = F.array_sort(
        "r",
        lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["ordinal"] < y["ordinal"], -1).otherwise(1),
    )
    cut = F.when(F.size("r") > most, F.slice(order, 1, most)).otherwise(F.col("r"))
    return kept.select("frame", "n_raw", cut.cast(RECORD).alias("records"), "c.*").drop("_")


def rows(found: DataFrame) -> DataFrame:
    """One row for each record, with its class name."""
    return found.select("frame", F.inline("records")).withColumn("category_name", coco_name(F.col("category_id")))


def rows_from_rows(raw: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """The same from rows (frame, ordinal, score, label): one shuffle by frame, for detections that come one by one."""
    order = Window.partitionBy("frame").orderBy(F.desc("score"), "ordinal")
    kept = raw.filter(at_least(F.col("score"), threshold, raw.schema["score"].dataType.simpleString())).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return kept.withColumn("category_name", coco_name(F.col("label")))


def named(records: str) -> Column:
    """An array of records as they are written: box, score, id and name."""
    return F.transform(records, lambda x: F.struct(x["bbox_xyxy"].cast("array<double>").alias("bbox_xyxy"), x["score"].alias("score"), x["category_id"].alias("category_id"), coco_name(x["category_id"]).alias("category_name")))


def documents(found: DataFrame) -> DataFrame:
    """(frame, json): an array of records for every frame, also for those without any."""
    return found.select("frame", F.to_json(named("records")).alias("json"))


def captions(found: DataFrame) -> DataFrame:
    """(frame, ordinal, caption) of every record: its class name and its score with two decimals."""
    return rows(found).select("frame", "ordinal", F.concat("category_name", F.lit(": "), shown(F.col("score"), 2)).alias("caption"))


def label_range(raw: DataFrame) -> DataFrame:
    """(frame, min_label, max_label) before any filter; null for frames without boxes."""
    return raw.select("frame", F.array_min("labels").alias("min_label"), F.array_max("labels").alias("max_label"))

"""Detections from a stream of detector outputs.

Post-processing works on one row at a time, so the batch operators run on a stream as they are: no state,
no watermark, append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from framewright.operators.detection import MOST, THRESHOLD, detections, rows

RAW = "frame string, boxes array<array<float>>, scores array<float>, labels array<bigint>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Detector outputs in Parquet files as they arrive."""
    return spark.readStream.schema(RAW).parquet(path)


def start(raw: DataFrame, path: str, checkpoint: str, threshold: float = THRESHOLD, most: int = MOST) -> StreamingQuery:
    """Write detection rows as they come; the checkpoint lets a lost query go on without loss or repeats."""
    return rows(detections(raw, threshold, most)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

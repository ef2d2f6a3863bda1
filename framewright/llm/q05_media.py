"""Query op5: every text stored as an image, read back and described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.media import media_digest


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op5_media": op5_media}

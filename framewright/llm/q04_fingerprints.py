"""Query op4: Order MinHash fingerprints of every document and its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.fingerprints import with_next


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}

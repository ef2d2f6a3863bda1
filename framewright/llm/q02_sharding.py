"""Query op2: documents in eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.sharding import shard_by_bytes


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sharding": op2_sharding}

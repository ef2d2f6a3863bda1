"""Query op1: every document encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm.bpe import round_trip
from framewright.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op1_bpe": op1_bpe}

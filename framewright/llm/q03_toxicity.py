"""Query op3: the severity of every document, by a model fitted on the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.toxicity import fit, score


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents.select("doc_id", "text"), model).drop("text")


QUERIES = {"op3_toxicity": op3_toxicity}

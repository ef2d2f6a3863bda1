"""Query op11: of every hundredth vector the ten others of largest inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table
from framewright.llm.topk import top_k


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


QUERIES = {"op11_topk": op11_topk}

ORACLE_SQL = {
    "op11_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
             s AS (SELECT q.row AS asker, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}

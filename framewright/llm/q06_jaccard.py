"""Query op6: components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.jaccard import similar_classes


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), 4, 85)


ORACLE_SQL = {
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) < 4 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), e AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s
), c AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM c WHERE 100 * k >= 85 * (n + m - k)
), sides AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id AS x, doc_id AS r FROM s UNION SELECT sides.y, reach.r FROM reach JOIN sides ON sides.x = reach.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.r) AS component_id FROM s JOIN reach ON reach.x = s.doc_id GROUP BY ALL
"""
}
QUERIES = {"op6_jaccard": op6_jaccard}

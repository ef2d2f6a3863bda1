"""Query op7: pages written as WARC archives with revisits and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table
from framewright.llm.warc import report


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc": op7_warc}

ORACLE_SQL = {
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
        FROM o"""
}

"""Query op10: every conversation from every participant's seat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.chat import rotate
from framewright.llm.common import table


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask is written as text, "from-to" joined by commas, so that any engine can compare it."""
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


QUERIES = {"op10_chat": op10_chat}

# Marks in texts and speakers get a backslash, as the operator has them.
_BODY = r"regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g')"
_SPEAKER = r"regexp_replace(regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g'), '<(\\*)\z', '<\\\1')"

ORACLE_SQL = {
    "op10_chat": f"""
        WITH told AS (SELECT conv_id, {_SPEAKER} AS speaker, {_BODY} AS body,
                             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_SPEAKER}, {_BODY}) - 1 AS seq
                      FROM conversations),
             seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM told WHERE speaker <> 'system'),
             seen AS (SELECT t.conv_id, perspective, seq, body, speaker = perspective AS trained,
                             '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END || '|>' || chr(10) AS head
                      FROM told t JOIN seats s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
             cut AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM seen),
             ran AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS stop FROM cut),
             whole AS (SELECT *, seq // 256 AS part, stop - length(segment) AS start FROM ran),
             put AS (SELECT *, min(start) OVER (PARTITION BY conv_id, perspective, part) AS first_char FROM whole)
        SELECT conv_id, perspective, part::BIGINT AS part, first_char::BIGINT AS first_char, count(*) AS n_messages,
               string_agg(segment, '' ORDER BY seq) AS text,
               coalesce(string_agg(CASE WHEN trained THEN (start + length(head) - first_char)::BIGINT || '-' || (stop - first_char)::BIGINT END, ',' ORDER BY seq), '') AS mask
        FROM put GROUP BY conv_id, perspective, part, first_char"""
}

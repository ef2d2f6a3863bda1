"""Query op12: product codes of every embedding after six rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.codes import books_digest, code_text, codes, with_label_error
from framewright.llm.common import table


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes(table(spark, sf_dir, "embeddings"), 8, 16, 6, 4096)
    out = with_label_error(coded.withColumn("code", code_text(F.col("codes"))))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


QUERIES = {"op12_codes": op12_codes}


def _rounds(n: int) -> str:
    """CTEs a1, b1 ... a(n+1): assignments of all parts, and the codebooks after them."""
    out = []
    for r in range(n + 1):
        out.append(f"""a{r} AS (SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT s.row, s.p, b.e, list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts s JOIN b{r} b ON s.p = b.p) GROUP BY row, p)""")
        if r < n:
            out.append(f"""m{r} AS (SELECT s.p, a.e, i, floor(sum(s.v[i])::DOUBLE / count(*))::BIGINT AS x FROM parts s JOIN a{r} a USING (row, p), range(1, 9) t(i) GROUP BY s.p, a.e, i),
            n{r} AS (SELECT p, e, list(x ORDER BY i) AS v FROM m{r} GROUP BY p, e),
            b{r + 1} AS (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN n{r} n USING (p, e))""")
    return ",\n".join(out)


ORACLE_SQL = {
    "op12_codes": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
             parts AS MATERIALIZED (SELECT row, p::INT AS p, v[p * 8 + 1:p * 8 + 8] AS v FROM v, range(8) t(p)),
             first AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 16),
             b0 AS (SELECT p, e::INT AS e, v FROM parts JOIN first USING (row)),
             {_rounds(6)},
             coded AS (SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY row),
             books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, v[i] AS x FROM b6, range(1, 9) t(i)))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (row), books"""
}

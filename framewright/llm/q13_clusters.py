"""Query op13: every embedding's cluster after three rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.clusters import clusters, with_inertia
from framewright.llm.common import table


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"), 16, 3, 64, 64, "1:")
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op13_clusters": op13_clusters}


def _rounds(n: int) -> str:
    """CTEs a0, c1 ... a(n): assignments, and the centroids after them."""
    out = []
    for r in range(n + 1):
        out.append(f"""a{r} AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT v.row, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY row)""")
        if r < n:
            out.append(f"""n{r} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT a.c, i, floor(sum(v.v[i])::DOUBLE / count(*))::BIGINT AS x FROM v JOIN a{r} a USING (row), range(1, 65) t(i) GROUP BY a.c, i) GROUP BY c),
            c{r + 1} AS (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (c))""")
    return ",\n".join(out)


ORACLE_SQL = {
    "op13_clusters": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
             c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v ORDER BY sha256('1:' || vec_id), v LIMIT 16),
             {_rounds(3)}
        SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
        FROM a3 JOIN v USING (row) JOIN c3 USING (c)"""
}

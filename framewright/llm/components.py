"""Connected components of a graph by alternating stars, on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour, as
    equi-joins with pre-aggregated minima; a node's neighbours stream past its minimum and are never held
    (of one with very many, Spark's skew join deals them over several tasks). It ends when a round
    changes nothing; the number of rounds grows with the logarithm of the number of nodes. Every round's edges are
    written to the shared folder.
    """
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = _sign(edges)
    while sign[0]:
        edges = saved(_small_star(_large_star(edges)), "edges")
        before, sign = sign, _sign(edges)
        if sign == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sign(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes, by which a change shows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from larger to smaller nodes here."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

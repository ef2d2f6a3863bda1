"""Reports on a segmentation head's raw queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.tensors import sigmoid, softmax, total
from framewright.operators import segmentation
from framewright.operators.segmentation import area

FIRST_QUERIES, TOP_CLASSES, TOP_QUERIES = 10, 5, 20


def top_classes(queries: DataFrame, most: int = TOP_CLASSES) -> DataFrame:
    """(frame, query, rank, class, prob) of the first queries' largest classes, the background included; ties by class."""
    p = softmax(F.col("logits"))
    pairs = F.transform(p, lambda v, i: F.struct(v.alias("prob"), i.alias("class")))
    ordered = F.array_sort(pairs, lambda x, y: F.when(x["prob"] > y["prob"], -1).when(x["prob"] < y["prob"], 1).when(x["class"] < y["class"], -1).otherwise(1))
    found = queries.filter(F.col("query") < FIRST_QUERIES).select("frame", "query", F.posexplode(F.slice(ordered, 1, most)).alias("pos", "p"))
    return found.select("frame", "query", (F.col("pos") + 1).alias("rank"), "p.class", "p.prob")


def mask_stats(queries: DataFrame) -> DataFrame:
    """Least, largest and mean mask value and sigmoid, and pixels over 0.5, of the first queries at the mask's own size."""
    mask = F.col("mask").cast("array<double>")

    def three(values: Column, name: str) -> list[Column]:
        return [F.array_min(values).alias(f"{name}_min"), F.array_max(values).alias(f"{name}_max"), (total(values) / F.size(values)).alias(f"{name}_mean")]

    return queries.filter(F.col("query") < FIRST_QUERIES).select(
        "frame", "query", *three(mask, "mask"), *three(F.transform(mask, sigmoid), "sigmoid"), area(mask).alias("area_native"), F.size(mask).cast("long").alias("n_pixels")
    )


def ordered(valid: DataFrame) -> DataFrame:
    """Valid queries by falling foreground, ties by query."""
    return valid.orderBy(F.desc("fg_prob"), "frame", "query")


def top_queries(valid: DataFrame, most: int = TOP_QUERIES) -> DataFrame:
    return ordered(valid).limit(most)


def query_counts(queries: DataFrame, least: int) -> DataFrame:
    """(frame, n_queries, n_valid, n_kept): all queries, the valid ones, and those of at least `least` pixels, in one pass over them."""
    valid = segmentation.is_valid(F.col("h"))
    # outer, as the optimiser would test an inner one beforehand with heads of its own
    heads = queries.select("frame", "mask", F.explode_outer(F.array(segmentation.head(F.col("logits")))).alias("h"))
    flags = heads.select("frame", valid.alias("valid"), F.when(valid, segmentation.area(F.col("mask"))).alias("area"))
    return flags.groupBy("frame").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & (F.col("area") >= least)).alias("n_kept"))


def counts(queries: DataFrame, valid: DataFrame, kept: DataFrame) -> DataFrame:
    """(frame, n_queries, n_valid, n_kept)."""
    n = lambda df, name: df.groupBy("frame").agg(F.count(F.lit(1)).alias(name))
    out = n(queries, "n_queries").join(n(valid, "n_valid"), "frame", "left").join(n(kept, "n_kept"), "frame", "left")
    return out.fillna(0, ["n_valid", "n_kept"])

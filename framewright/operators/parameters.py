"""Reports on a checkpoint's parameters, rows (ordinal, key, is_tensor, shape array<bigint>, dtype)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What marks a key as of a category, and how many of each the report lists.
CATEGORIES = {
    "backbone": (("blocks", "patch_embed", "pos_embed"), 5),
    "detection": (("detector", "rpn", "roi", "box", "class"), 5),
    "segmentation": (("decoder", "head", "mask_embed", "query"), 10),
    "output": (("fc", "classifier", "linear"), 10),
}
HEAD_MARKS, HEADS, LISTED = ("head", "decoder", "classifier", "fc"), 10, 30
NOT_METADATA = ("model", "state_dict")


def has_any(key: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (key.contains(m) for m in marks))


def listing(params: DataFrame, most: int = LISTED) -> DataFrame:
    """The first parameters in order: shape and dtype of tensors, the type's name of others."""
    shown = F.when(F.col("is_tensor"), F.concat(F.lit("("), F.array_join(F.col("shape").cast("array<string>"), ", "), F.lit(")"))).otherwise("")
    return params.orderBy("ordinal").limit(most).select("ordinal", "key", shown.alias("shape"), "dtype")


def modules(params: DataFrame) -> DataFrame:
    """(module, n, first_ordinal): parameters by their key's first dotted part, most first, ties by first appearance."""
    return params.groupBy(F.substring_index("key", ".", 1).alias("module")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal")).orderBy(F.desc("n"), "first_ordinal")


def categories(params: DataFrame) -> DataFrame:
    """(category, n) in one pass; categories overlap."""
    sums = [F.count_if(has_any(F.col("key"), marks)).alias(name) for name, (marks, _) in CATEGORIES.items()]
    names = ", ".join(f"'{c}', {c}" for c in CATEGORIES)
    return params.agg(*sums, F.count(F.lit(1)).alias("total")).select(F.expr(f"stack({len(CATEGORIES) + 1}, {names}, 'total', total) AS (category, n)"))


def category_keys(params: DataFrame, category: str) -> DataFrame:
    """The category's first keys in order; of output layers only tensors among them."""
    marks, most = CATEGORIES[category]
    first = params.filter(has_any(F.col("key"), marks)).orderBy("ordinal").limit(most)
    return (first.filter("is_tensor") if category == "output" else first).select("ordinal", "key")


def dataset(dimension: Column, kind: str) -> Column:
    """What a head's output dimension suggests; null where nothing is said."""
    if kind == "segmentation":
        return F.when(dimension == 150, "ADE20K").when(dimension == 21, "PASCAL VOC").when(dimension == 19, "Cityscapes").otherwise("unknown")
    if kind == "detection":
        return F.when(dimension.isin(80, 81), "COCO").when(dimension.isin(20, 21), "PASCAL VOC")
    return F.lit(None).cast("string")


def heads(params: DataFrame, kind: str = "unknown") -> DataFrame:
    """(ordinal, key, out_dim, dataset): of the first 10 weights of heads, those with two dimensions or more."""
    found = params.filter(F.col("key").endswith(".weight") & has_any(F.col("key"), HEAD_MARKS)).orderBy("ordinal").limit(HEADS)
    found = found.filter(F.col("is_tensor") & (F.size("shape") >= 2)).withColumn("out_dim", F.get("shape", 0))
    return found.select("ordinal", "key", "out_dim", dataset(F.col("out_dim"), kind).alias("dataset"))


def metadata(top_level: DataFrame) -> DataFrame:
    """Keys of a checkpoint's top level that hold no parameters."""
    return top_level.filter(~F.col("key").isin(*NOT_METADATA))


def complete(files: DataFrame) -> DataFrame:
    """Adds gib and is_complete to a listing (path, length): files named lvd1689m need 15 GiB."""
    gib = F.col("length") / F.lit(1024.0**3)
    return files.withColumn("gib", gib).withColumn("is_complete", ~(F.col("path").contains("lvd1689m") & (gib < 15)))


def verify(spark: SparkSession, path: str, load: Callable[[str], object]) -> DataFrame:
    """One row (path, found, gib, loads, reason, is_complete) on a checkpoint file: it exists, is large enough and can be loaded.

    `load` takes the path and raises what is wrong; it runs in a task, and not for a file that is missing or too small.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.exists(where)
    length = store.getFileStatus(where).getLen() if found else None
    file = complete(spark.createDataFrame([(path, found, length)], "path string, found boolean, length long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reasons = []
            for row in batch.itertuples():
                reason = "no such file" if not row.found else None if row.is_complete else "too small"
                if reason is None:
                    try:
                        load(row.path)
                    except Exception as e:  # whatever a loader raises means that the file can't be loaded
                        reason = str(e) or type(e).__name__
                reasons.append(reason)
            loads = [r is None for r in reasons]
            yield batch.assign(loads=loads, reason=reasons, is_complete=loads)[["path", "found", "gib", "loads", "reason", "is_complete"]]

    return file.mapInPandas(run, "path string, found boolean, gib double, loads boolean, reason string, is_complete boolean")


def report(params: DataFrame, top_level: DataFrame | None = None, kind: str = "unknown") -> dict[str, DataFrame]:
    """All reports on a checkpoint by name, each a table of bounded length but `modules` and `metadata`."""
    out = {"listing": listing(params), "modules": modules(params), "categories": categories(params), "heads": heads(params, kind)}
    out |= {f"{c}_keys": category_keys(params, c) for c in CATEGORIES}
    return out if top_level is None else out | {"metadata": metadata(top_level)}

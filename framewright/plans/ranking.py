"""Places of rows in one order over a whole table, without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of `monotonically_increasing_id` that count a partition's rows.
_ROWS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with `name`: each row's place from 1 in `order`. Rows that the order holds equal have neighbouring places, in no order of their own.

    A range shuffle sorts the rows and they are written once, so that places don't depend on how often they are read; what comes before
    a partition is a sum over the partitions' counts, one row each. Rows that are all equal in `order` meet in one task; add a column
    that tells them apart.
    """
    path = f"{shared_folder(df.sparkSession)}/framewright/{uuid.uuid4().hex}/ranked"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    before, offsets = 0, []
    for part in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        offsets.append((part["_part"], before))
        before += part.n
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before long")  # one row a partition of the shuffle
    place = F.col("_before") + F.col("_row").bitwiseAND((1 << _ROWS) - 1) + 1
    return placed.join(F.broadcast(known), "_part").select(*df.columns, place.alias(name))

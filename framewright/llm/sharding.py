"""Contiguous shards of near equal bytes, cut from global prefix sums.

All rows stand in one global order: groups of equal texts by falling bytes of the group, then by
content key, then by id. A range shuffle deals that order over partitions; each partition's totals
(one row each) give every partition its offset, and an offset plus the sums within the partition
is the global prefix sum. Shards are cut where the prefix sum passes equal targets, at the group
whose middle comes after the target, so no group is split. Groups of at least a whole target (at
most as many as there are shards) take a shard each, and the rest is cut into the other shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import saved

_KEY = ["size", "content", "text_crc32"]
#: A group with more than one row in so many is large.
LARGE = 500


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text plus 1; a null text has none, like an empty one. Rows of equal texts
    (null and empty are equal) get one shard; slot counts each shard's rows from 0 in the global order.
    A null id sorts first; repeated rows each get a slot of their own; an empty table gives no rows.
    Other columns don't matter. grown_shard is null: growing belongs to another law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("content"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    groups = saved(rows.groupBy(*_KEY).agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("copies")), "groups")
    order = [F.desc("group_bytes"), F.asc("content"), F.asc("size"), F.asc("text_crc32"), F.asc_nulls_first("doc_id")]
    placed = _grouped(rows, groups).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("pid", F.spark_partition_id()), "placed")

    total, large = _totals(placed, shards)
    within = Window.partitionBy("pid").orderBy(*order)
    key = F.struct(*_KEY)
    placed = placed.select(
        "*",
        (F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.row_number().over(within) - 1).cast("long").alias("row"),
        key.alias("key"),
    ).withColumn("group_before", F.min("before").over(Window.partitionBy("pid", *_KEY)))
    offsets = _offsets(placed)
    # one row for each partition of the range shuffle: its number is a setting and doesn't grow with the rows
    placed = placed.join(F.broadcast(offsets), "pid")
    start = F.col("bytes_before") + F.when(F.col("key") == F.col("first_key"), -F.col("carried")).otherwise(F.col("group_before"))
    placed = placed.select("doc_id", "size", "text_crc32", _shard(start, F.col("group_bytes"), shards, total, large).alias("shard"), (F.col("rows_before") + F.col("row")).alias("index"))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group's group_bytes. Groups of more than one row in LARGE (so fewer than LARGE groups) are broadcast; their
    rows go through the join by spread keys that match nothing, so no task gets all copies of a text."""
    n = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    large = groups.filter(F.col("copies") * LARGE > n).select(*_KEY, F.col("group_bytes").alias("large_bytes"))
    found = rows.join(F.broadcast(large), _KEY, "left")
    spread = F.when(F.col("large_bytes").isNull(), F.col("content")).otherwise(F.xxhash64("doc_id", "content"))
    found = found.withColumn("met", spread).join(groups.select("size", F.col("content").alias("met"), "text_crc32", "group_bytes"), ["size", "met", "text_crc32"], "left")
    return found.withColumn("group_bytes", F.coalesce("large_bytes", "group_bytes")).drop("met", "large_bytes")


def _totals(placed: DataFrame, shards: int) -> tuple[int, list[int]]:
    """All bytes, and the bytes of the groups that fill a target by themselves (at most `shards`), falling."""
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = placed.filter(F.col("group_bytes") * shards >= total).groupBy(*_KEY).agg(F.first("group_bytes").alias("b")).select("b").collect()
    return total, sorted((r.b for r in found), reverse=True)


def _offsets(placed: DataFrame) -> DataFrame:
    """Of each partition: bytes and rows before it, its first key, and that key's bytes in the partitions before."""
    place = F.struct("row", "key")
    parts = (
        placed.groupBy("pid")
        .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("group_before").alias("last_start"))
        .orderBy("pid")
        .collect()
    )
    out, done, rows, carried, last = [], 0, 0, 0, None
    for p in parts:
        if p.lo.key != last:
            carried = 0
        out.append((p.pid, done, rows, tuple(p.lo.key), carried))
        carried = carried + p.b if p.lo.key == p.hi.key else p.b - p.last_start
        done, rows, last = done + p.b, rows + p.n, p.hi.key
    kind = placed.schema["key"].dataType.simpleString()
    return placed.sparkSession.createDataFrame(out, f"pid int, bytes_before long, rows_before long, first_key {kind}, carried long")


def _shard(start: Column, size: Column, shards: int, total: int, large: list[int]) -> Column:
    """The shard of a group that begins after `start` bytes: by its middle, among those that no large group has."""
    left, own = shards - len(large), sum(large)
    if not left:
        cut = F.lit(shards - 1)
    else:
        middle = start - own + F.floor(size / 2)
        cut = F.lit(len(large)) + F.least(F.lit(left - 1), F.floor(middle * left / F.lit(max(1, total - own))))
    out = cut.cast("int")
    done = 0
    for k, b in enumerate(large):
        out = F.when(start == done, F.lit(k)).otherwise(out)
        done += b
    return out.cast("int")

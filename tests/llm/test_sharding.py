from __future__ import annotations

import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.llm import sharding as S
from framewright.llm.sharding import shard_by_bytes


def check(rows: list[tuple], found: pd.DataFrame, shards: int = 8) -> pd.Series:
    text = {}
    for i, t in rows:
        text.setdefault(i, t or "")
    assert len(found) == len(rows) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for r in found.itertuples():
        data = text[None if pd.isna(r.doc_id) else int(r.doc_id)].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    for shard, part in found.groupby("shard"):
        assert 0 <= shard < shards and sorted(part.slot) == list(range(len(part)))
    assert (found.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()
    return found.groupby("shard")["size"].sum()


def plain(rows, hashes, shards=8):
    """(doc_id, shard, slot) by the definition: groups by falling bytes and content, cut by the prefix sums of their middles."""
    def order(r):
        data = (r[1] or "").encode()
        key = (len(data) + 1, hashes[r[1] or ""], zlib.crc32(data))
        return -groups[key], key[1], key[0], key[2], r[0] is not None, r[0] or 0

    groups = {}
    for _, t in rows:
        data = (t or "").encode()
        key = (len(data) + 1, hashes[t or ""], zlib.crc32(data))
        groups[key] = groups.get(key, 0) + key[0]
    total = sum(groups.values())
    large = [k for k, b in groups.items() if b * shards >= total]
    left, own = shards - len(large), sum(groups[k] for k in large)
    out, start, number, slots = [], 0, {}, {}
    for r in sorted(rows, key=order):
        data = (r[1] or "").encode()
        key = (len(data) + 1, hashes[r[1] or ""], zlib.crc32(data))
        if key not in number:
            if key in large:
                number[key] = len(number)
            else:
                number[key] = len(large) + min(left - 1, (start - own + groups[key] // 2) * left // max(1, total - own))
            start += groups[key]
        shard = number[key]
        out.append((r[0], shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return sorted(map(str, out))


@pytest.mark.parametrize("large", [S.LARGE, 3, 10**9])
def test_like_the_definition(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE", large)
    draw = random.Random(large)
    texts = ["x" * draw.randint(0, 60) + str(i) for i in range(60)] + [None, "", "é" * 9, "long " * 9000]
    for hot in (0, 300):
        rows = [(i, draw.choice(texts)) for i in range(400)] + [(1000 + i, "hot") for i in range(hot)] + [(None, "hot"), (7, "a"), (7, "a")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("h", F.xxhash64("t")).collect()}
        found = sorted(str((r.doc_id, r.shard, r.slot)) for r in shard_by_bytes(docs).collect())
        assert found == plain(rows, hashes)


def test_copies_of_one_text_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.xxhash64("text").alias("content"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))
    groups = rows.groupBy(*S._KEY).agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("copies"))
    met = S._grouped(rows, groups)
    assert met.filter("group_bytes = 8000").count() == 2000 and met.filter("group_bytes IS NULL").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parts = S._grouped(rows, groups).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in parts) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_equal_shards(spark):
    rows = [(i, "x" * (i * 7919 % 97)) for i in range(900)]
    found = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    sizes = check(rows, found)
    assert len(sizes) == 8


def test_distinct_texts_balance(spark):
    rows = [(i, f"{i} " + "y" * (i * 31 % 200)) for i in range(1500)]
    sizes = check(rows, shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas())
    assert sizes.max() - sizes.min() <= 2 * 210


def test_hot_group_stays_whole_and_leaves_the_rest_even(spark):
    rows = [(i, "hot text") for i in range(400)] + [(1000 + i, f"row {i}") for i in range(800)] + [(None, None), (5000, ""), (5000, "")]
    found = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).toPandas()
    sizes = check(rows, found)
    assert found[found.doc_id < 400].shard.nunique() == 1
    rest = sizes.drop(found[found.doc_id < 400].shard.iloc[0])
    assert len(rest) == 7 and rest.max() - rest.min() <= 40


def test_empty_and_extra_columns(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = shard_by_bytes(spark.createDataFrame([(1, "a", 9, "pid")], "doc_id long, text string, shard int, pid string")).first()
    assert (one.doc_id, one.size, one.slot) == (1, 2, 0)

"""Query-based semantic segmentation: valid queries, label maps, and what they cover."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.names import ade20k_name
from framewright.functions.tensors import argmax, background, bound, foreground, shifted_exp, shown, sigmoid, total

LEAST_FOREGROUND, LEAST_AREA, TOP_CLASSES = 0.5, 50, 15


def head(logits: Column) -> Column:
    """(class, fg_prob, bg_prob) of logits whose last entry is the background. Only sums and maxima are
    taken of the exponentials, so no probability array is made."""
    return bound(
        shifted_exp(logits),
        lambda x: bound(total(x), lambda s: F.struct(argmax(foreground(x)).alias("class"), (F.array_max(foreground(x)) / s).alias("fg_prob"), (background(x) / s).alias("bg_prob"))),
    )


def is_valid(found: Column) -> Column:
    """Whether a head's foreground beats the background and 0.5, both strictly; NaN is never valid."""
    return ~F.isnan(found["fg_prob"]) & (found["fg_prob"] > found["bg_prob"]) & (found["fg_prob"] > LEAST_FOREGROUND)


def class_heads(queries: DataFrame) -> DataFrame:
    """Adds class, fg_prob and bg_prob from `logits`."""
    return queries.withColumn("_h", head(F.col("logits"))).select("*", "_h.class", "_h.fg_prob", "_h.bg_prob").drop("_h")


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries whose head `is_valid`, with class, fg_prob and bg_prob. Heads are made within an array and filtered there: a filter on columns would compute them again for each of its conditions."""
    return queries.select("*", F.inline_outer(F.filter(F.array(head(F.col("logits"))), is_valid))).filter("class IS NOT NULL")


def area(mask: Column) -> Column:
    """Pixels whose sigmoid is over 0.5, that is whose logit is over 0; NaN isn't."""
    return F.size(F.filter(mask, lambda v: ~F.isnan(v) & (sigmoid(v.cast("double")) > 0.5))).cast("bigint")


def surviving(valid: DataFrame, least: int = LEAST_AREA) -> DataFrame:
    """Valid queries of at least `least` pixels. The filter stands before any pixel is exploded."""
    return valid.withColumn("area", area(F.col("mask"))).filter(F.col("area") >= least)


def label_map(kept: DataFrame, frames: DataFrame, digits: int | None = None) -> DataFrame:
    """(frame, y, x, label, weight) of every pixel of `frames` (frame, height, width), from kept queries with row-major masks.

    A pixel has the class of the query whose sigmoid times fg_prob is largest, of equal ones the lowest
    query; without a positive weight it is label 0 with weight 0. One shuffle by pixel, pre-aggregated.
    digits rounds weights before they are compared.
    """
    weight = sigmoid(F.col("v").cast("double")) * F.col("fg_prob")
    painted = kept.select("frame", "query", "class", "fg_prob", "mask_w", F.posexplode("mask").alias("pos", "v")).filter(~F.isnan("v"))
    painted = painted.select("frame", "query", "class", F.expr("pos div mask_w").cast("int").alias("y"), (F.col("pos") % F.col("mask_w")).cast("int").alias("x"), (F.round(weight, digits) if digits else weight).alias("w")).filter("w > 0")
    best = painted.groupBy("frame", "y", "x").agg(F.max(F.struct("w", (-F.col("query")).alias("q"), "class")).alias("b"))
    grid = frames.select("frame", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select("frame", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return grid.join(best, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("b.class", F.lit(0)).alias("label"), F.coalesce("b.w", F.lit(0.0)).alias("weight"))


def resize(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, corners not aligned: sample centres map to centres, clamped at the edges; float32. A mask of that size stays as it is."""
    if mask.shape == (height, width):
        return mask

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((np.arange(m, dtype=np.float32) + 0.5) * np.float32(n / m) - 0.5, 0).astype(np.float32)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(mask.shape[0], height)
    x0, x1, fx = axis(mask.shape[1], width)
    rows = mask[y0] * (1 - fy)[:, None] + mask[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def resized(queries: DataFrame) -> DataFrame:
    """Queries with `mask` resized to columns height and width, by Arrow batches, before any sigmoid."""
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                cell = {n: one.column(i)[0].as_py() for i, n in enumerate(names) if n in ("mask_h", "mask_w", "height", "width")}
                mask = np.asarray(one.column(names.index("mask")).flatten(), np.float32).reshape(cell["mask_h"], cell["mask_w"])
                new = {"mask": pa.array([resize(mask, cell["height"], cell["width"]).ravel()], pa.list_(pa.float32())), "mask_h": pa.array([cell["height"]], pa.int32()), "mask_w": pa.array([cell["width"]], pa.int32())}
                yield pa.RecordBatch.from_arrays([new.get(n, one.column(i)) for i, n in enumerate(names)], names)

    return queries.mapInArrow(run, queries.schema)


def painted(queries: Iterable[tuple[int, float, np.ndarray]], height: int, width: int, least: int = LEAST_AREA) -> tuple[np.ndarray, list[int]]:
    """The label map of (class, fg_prob, mask) in query order, and each query's area at full size.

    Masks are resized one at a time, so a frame's full-size masks are never held together. Queries under `least` pixels leave no label.
    """
    best, labels, areas = np.zeros((height, width)), np.zeros((height, width), np.int32), []
    for kind, fg, mask in queries:
        with np.errstate(over="ignore"):
            share = 1 / (1 + np.exp(-resize(mask, height, width).astype(np.float64)))
        areas.append(int((share > 0.5).sum()))
        if areas[-1] >= least:
            over = share * fg > best
            best[over], labels[over] = share[over] * fg, kind
    return labels, areas


def dense_label_map(valid: DataFrame, least: int = LEAST_AREA) -> DataFrame:
    """(frame, height, width, labels array<int>) of each frame with valid queries, in full size (columns height and width).

    One shuffle by frame, of masks in the model's size; a task holds one frame's queries, whose number the model fixes.
    For outputs that come one row a frame, `segment` needs no shuffle.
    """

    def paint(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("query")
        height, width = int(frame["height"].iloc[0]), int(frame["width"].iloc[0])
        masks = (np.asarray(m, np.float32).reshape(h, w) for m, h, w in zip(frame["mask"], frame["mask_h"], frame["mask_w"], strict=True))
        labels, _ = painted(zip(frame["class"], frame["fg_prob"], masks, strict=True), height, width, least)
        return pd.DataFrame({"frame": [frame["frame"].iloc[0]], "height": [height], "width": [width], "labels": [labels.ravel()]})

    kind = valid.schema["frame"].dataType.simpleString()
    return valid.select("frame", "query", "class", "fg_prob", "mask", "mask_h", "mask_w", "height", "width").groupBy("frame").applyInPandas(paint, f"frame {kind}, height int, width int, labels array<int>")


def rejected(raw: DataFrame) -> DataFrame:
    """Frames whose output lacks its logits or its masks; they give no label map."""
    return raw.filter("logits IS NULL OR masks IS NULL").select("frame")


def segment(raw: DataFrame, least: int = LEAST_AREA, carry: Sequence[str] = ()) -> DataFrame:
    """(frame, height, width, labels array<int>, queries, n_valid, carry) of a segmentor's rows (frame, height, width, logits, masks, mask_h, mask_w).

    logits and masks hold one array a query. labels is the map in full size, all 0 for frames without a valid query;
    queries are the valid ones of at least `least` pixels, (query, class, fg_prob, bg_prob, area), n_valid counts those of any size. Columns
    named in `carry` go along. One row in and one out: nothing is shuffled.
    """
    size = F.least(F.size("logits"), F.size("masks"))
    numbered = F.when(size > 0, F.arrays_zip(F.sequence(F.lit(0), size - 1).alias("query"), F.slice("logits", 1, size).alias("logits"), F.slice("masks", 1, size).alias("mask"))).otherwise(F.array())
    headed = F.transform(numbered, lambda q: F.struct(q["query"].alias("query"), head(q["logits"]).alias("h"), q["mask"].alias("mask")))
    flat = F.transform(F.filter(headed, lambda q: is_valid(q["h"])), lambda q: F.struct(q["query"].alias("query"), q["h"]["class"].alias("class"), q["h"]["fg_prob"].alias("fg_prob"), q["h"]["bg_prob"].alias("bg_prob"), q["mask"].alias("mask")))
    ready = raw.filter("logits IS NOT NULL AND masks IS NOT NULL").select("frame", "height", "width", "mask_h", "mask_w", flat.alias("valid"), *(F.col(c).alias(f"_carried_{i}") for i, c in enumerate(carry)))
    names = ("query", "class", "fg_prob", "bg_prob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, mask_h, mask_w = (batch.column(i)[k].as_py() for i in range(1, 5))
                valid = batch.column(5)[k].values
                kinds, fgs, masks = (valid.field(n) for n in ("class", "fg_prob", "mask"))
                inputs = ((kinds[i].as_py(), fgs[i].as_py(), masks[i].values.to_numpy(zero_copy_only=False).reshape(mask_h, mask_w)) for i in range(len(valid)))
                labels, areas = painted(inputs, height, width, least)
                kept = [{n: valid.field(n)[i].as_py() for n in names} | {"area": a} for i, a in enumerate(areas) if a >= least]
                cells = [pa.array([labels.ravel()], pa.list_(pa.int32())), pa.array([kept], _KEPT), pa.array([len(valid)], pa.int32())]
                row = batch.slice(k, 1).columns
                yield pa.RecordBatch.from_arrays([*row[:3], *cells, *row[6:]], ["frame", "height", "width", "labels", "queries", "n_valid", *carry])

    kind = raw.schema["frame"].dataType.simpleString()
    return ready.mapInArrow(run, f"frame {kind}, height int, width int, labels array<int>, queries array<struct<query:int,class:int,fg_prob:double,bg_prob:double,area:bigint>>, n_valid int" + "".join(f", {c} {raw.schema[c].dataType.simpleString()}" for c in carry))


_KEPT = pa.list_(pa.struct([("query", pa.int32()), ("class", pa.int32()), ("fg_prob", pa.float64()), ("bg_prob", pa.float64()), ("area", pa.int64())]))


def query_report(found: DataFrame) -> DataFrame:
    """(frame, query, name, prob, area) of `segment`'s queries, each frame's most probable first; prob as text of three decimals."""
    rows = found.select("frame", F.inline("queries"))
    return rows.orderBy("frame", F.desc("fg_prob"), "query").select("frame", "query", ade20k_name(F.col("class")).alias("name"), shown(F.col("fg_prob"), 3).alias("prob"), "area")


def map_pixels(dense: DataFrame) -> DataFrame:
    """(frame, y, x, label) of dense label maps, for the operators on pixels."""
    rows = dense.select("frame", "width", F.posexplode("labels").alias("pos", "label"))
    return rows.select("frame", F.expr("pos div width").cast("int").alias("y"), (F.col("pos") % F.col("width")).cast("int").alias("x"), "label")


def class_stats(labels: DataFrame) -> DataFrame:
    """(frame, label, n_pixels, share_pct, cx, cy) of every label in a frame; shares are of all pixels, centres are truncated means."""
    return _shared(labels.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")))


def _shared(counted: DataFrame) -> DataFrame:
    """Shares and centres from (frame, label, n_pixels, sum_x, sum_y)."""
    whole = F.sum("n_pixels").over(Window.partitionBy("frame"))
    centre = lambda c: F.floor(F.col(c) / F.col("n_pixels")).cast("int")
    return counted.select("frame", "label", "n_pixels", centre("sum_x").alias("cx"), centre("sum_y").alias("cy"), (F.col("n_pixels") / whole * 100).alias("share_pct"))


def label_counts(dense: DataFrame) -> DataFrame:
    """(frame, label, n_pixels, sum_x, sum_y) of dense label maps (frame, height, width, labels): a row for each label of a map, no row a pixel.

    The sums of several parts of a frame add up; a column `top`, if there is one, is the frame's row at which a part begins.
    """
    top = F.col("top").cast("int") if "top" in dense.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, first = (batch.column(i)[k].as_py() for i in (1, 2, 4))
                flat = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                kinds, place = np.unique(flat, return_inverse=True)
                rows, columns = np.divmod(np.arange(flat.size), max(width, 1))
                sums = [np.bincount(place, w, len(kinds)).astype(np.int64) for w in (None, columns, rows + first)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(kinds)), pa.array(kinds.astype(np.int32)), *map(pa.array, sums)], ["frame", "label", "n_pixels", "sum_x", "sum_y"])

    kind = dense.schema["frame"].dataType.simpleString()
    return dense.select("frame", "height", "width", "labels", top.alias("top")).mapInArrow(run, f"frame {kind}, label int, n_pixels long, sum_x long, sum_y long")


def dense_class_stats(dense: DataFrame) -> DataFrame:
    """`class_stats` of dense label maps, whole or in parts: maps are counted where they are, and a row for each of their labels is shuffled."""
    return _shared(label_counts(dense).groupBy("frame", "label").agg(*(F.sum(c).alias(c) for c in ("n_pixels", "sum_x", "sum_y"))))


def top_classes(stats: DataFrame, most: int = TOP_CLASSES) -> DataFrame:
    """Each frame's largest classes but 0, ties by label, with name and caption."""
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n_pixels"), "label"))
    named = stats.filter("label <> 0").withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("name", ade20k_name(F.col("label")))
    return named.withColumn("caption", F.concat("name", F.lit("\n"), shown(F.col("share_pct"), 1), F.lit("%")))


def coverage(stats: DataFrame) -> DataFrame:
    """(frame, n_labels, coverage_pct): distinct labels but 0, and the share of pixels that aren't 0."""
    return stats.groupBy("frame").agg(
        F.count_if(F.col("label") != 0).alias("n_labels"), (F.coalesce(F.sum(F.when(F.col("label") != 0, F.col("n_pixels"))), F.lit(0)) / F.sum("n_pixels") * 100).alias("coverage_pct")
    )


def boundary(labels: DataFrame) -> DataFrame:
    """(frame, y, x, label, is_boundary): a pixel of a class but 0 with a 4-neighbour that is missing or of another label."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    same = [F.coalesce(f("label").over(w) == F.col("label"), F.lit(False)) for w in (row, column) for f in (F.lag, F.lead)]
    return labels.select("frame", "y", "x", "label", ((F.col("label") != 0) & ~(same[0] & same[1] & same[2] & same[3])).alias("is_boundary"))


def outlines(labels: np.ndarray) -> np.ndarray:
    """Which pixels of a label map (height, width) are of a class but 0 and have a 4-neighbour that is missing or of another label."""
    same = np.ones(labels.shape, bool)
    for axis in (0, 1):
        step = np.diff(labels, axis=axis) == 0
        edge = np.zeros_like(np.take(same, [0], axis=axis))
        same &= np.concatenate([edge, step], axis=axis) & np.concatenate([step, edge], axis=axis)
    return (labels != 0) & ~same


def dense_boundary(dense: DataFrame) -> DataFrame:
    """Dense label maps (frame, height, width, labels) with is_boundary array<boolean>, row by row like labels; see `boundary`. Neighbours are compared within a frame's row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                labels = batch.column(3)[k].values.to_numpy(zero_copy_only=False).reshape(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([outlines(labels).ravel()], pa.list_(pa.bool_()))], ["frame", "height", "width", "labels", "is_boundary"])

    kind = dense.schema["frame"].dataType.simpleString()
    return dense.select("frame", "height", "width", "labels").mapInArrow(run, f"frame {kind}, height int, width int, labels array<int>, is_boundary array<boolean>")

"""Image files as tables: listing, decoding to RGB, and the two models' input pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tensors import DEVIATION, MEAN, normalised, scaled

#: Pixels of a frame that go out together.
PIXELS = 1 << 16
# The suffixes that a folder is searched for.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(path)
    return store.getFileStatus(where).isDirectory()


def path_order(path: Column) -> Column:
    """Sorts paths by their components, so that a/b comes before a-b."""
    return F.split(path, "/")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)(\.[^.]+)$", 1)


def _loaded(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    if _is_folder(spark, path):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}")
    return reader.load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime), sorted by components: a file as it is, or a folder's images of lower-case suffixes at any depth.

    Files without bytes, which Spark's readers pass over, have length 0 and no time. A path that doesn't exist raises FileNotFoundError,
    and a folder without images ValueError.
    """
    found = _loaded(spark, path, "binaryFile").drop("content")
    names = found._jdf.inputFiles()  # those that the reader's own index holds
    if not len(names):
        raise ValueError(f"no images in {path}")
    if len(names) != found.count():
        every = spark.createDataFrame([(n,) for n in names], "path string").select(plain_path(F.col("path")).alias("path"))
        empty = every.join(found.select("path"), "path", "left_anti")
        found = found.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime")))
    return found.orderBy(path_order(F.col("path")))


def plain_path(uri: Column) -> Column:
    """An encoded URI as the path that a listing has."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(frame, height, width, channels, data, reason) of image files; data is row-major bytes, blue first.

    A file that is no image has a reason and no data. One whose decoding breaks off (cut off, say) has no row: what `listing`
    has and this lacks couldn't be read, as `plans.files.write_frames` reports.
    """
    image = _loaded(spark, path, "image", ignoreCorruptFiles="true").select("image.*")
    whole = F.col("height") > 0
    cells = [F.when(whole, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return image.select(plain_path(F.col("origin")).alias("frame"), *cells, F.when(~whole, F.lit("no image that can be decoded")).alias("reason"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """`decoded` images that have data."""
    return decoded(spark, path).filter("reason IS NULL").drop("reason")


def samples(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Height x width x channels of an image in a batch of (height, width, channels, data), read in place."""
    height, width, channels, data = (batch.column(batch.schema.get_field_index(n))[row] for n in ("height", "width", "channels", "data"))
    shape = (height.as_py(), width.as_py(), channels.as_py())
    return np.frombuffer(data.as_buffer(), np.uint8)[: math.prod(shape)].reshape(shape)


def rgb(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """Red, green and blue of samples that have blue first; grey repeats its value."""
    return tuple(image[..., c if image.shape[-1] >= 3 else 0] for c in (2, 1, 0))


def pixels(images: DataFrame) -> DataFrame:
    """(frame, y, x, r, g, b): grey images repeat their value, alpha is dropped. Decoded bytes are read in place, PIXELS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                frame, image = batch.column(0)[k], samples(batch, k)
                width, flat = image.shape[1], image.reshape(-1, image.shape[2])
                for at in range(0, len(flat), PIXELS):
                    part = flat[at : at + PIXELS].astype(np.int32)
                    place = np.arange(at, at + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.repeat(frame, len(part)), *map(pa.array, (place // width, place % width, *rgb(part)))], ["frame", "y", "x", "r", "g", "b"])

    return images.select("frame", "height", "width", "channels", "data").mapInArrow(run, "frame string, y int, x int, r int, g int, b int")


def detector_input(pixel: DataFrame) -> DataFrame:
    """Pixels scaled to [0, 1] as float32; neither normalised nor resized."""
    return pixel.select("frame", "y", "x", *(scaled(F.col(c)).alias(c) for c in "rgb"))


def segmentor_input(pixel: DataFrame) -> DataFrame:
    """Pixels scaled and normalised by channel."""
    return pixel.select("frame", "y", "x", *(normalised(F.col(c), k).cast("float").alias(c) for k, c in enumerate("rgb")))


def shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image (its first two axes) resized with a triangle filter that widens with the reduction, so that nothing aliases.

    Weights at the edges are renormalised; results are rounded once, to bytes.
    """

    def axis(values: np.ndarray, m: int) -> np.ndarray:
        n = len(values)
        scale = n / m
        reach = max(scale, 1.0)
        centre = (np.arange(m) + 0.5) * scale
        place = np.maximum(np.floor(centre - reach + 0.5).astype(np.int64), 0)[:, None] + np.arange(int(2 * reach) + 2)
        weight = np.maximum(1 - np.abs((place + 0.5 - centre[:, None]) / reach), 0) * (place < n)
        weight /= weight.sum(axis=1, keepdims=True)
        out = np.zeros((m, *values.shape[1:]))
        for k in range(place.shape[1]):
            out += weight[:, k].reshape(-1, *[1] * (values.ndim - 1)) * values[np.minimum(place[:, k], n - 1)]
        return out

    rows = axis(image.astype(np.float64), height)
    return np.clip(np.rint(axis(rows.swapaxes(0, 1), width).swapaxes(0, 1)), 0, 255).astype(np.uint8)


def model_frames(images: DataFrame, size: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(frame, height, width, input, carry) of decoded images (`frames`): the model's input, channel by channel, row by row.

    Without a size the detector's: samples in [0, 1] at the image's own size. With one the segmentor's: resized to
    size x size whatever the aspect, scaled and normalised by channel. height and width stay the image's own. Columns
    named in `carry` go along (as carry has them, but for height and width). Images without data have a null input.
    """
    more = [c for c in carry if c not in ("height", "width")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ready = None
                if batch.column(4)[k].is_valid:
                    image = np.stack(rgb(samples(batch, k)), axis=-1)
                    if size is None:
                        ready = image.astype(np.float32) / np.float32(255)
                    else:
                        ready = ((shrunk(image, size, size) / 255 - MEAN) / DEVIATION).astype(np.float32)
                    ready = ready.transpose(2, 0, 1).ravel()
                values = pa.array([ready], pa.list_(pa.float32()))
                row = batch.slice(k, 1).columns
                yield pa.RecordBatch.from_arrays([*row[:3], values, *row[5:]], ["frame", "height", "width", "input", *more])

    kind = lambda c: images.schema[c].dataType.simpleString()
    named = [F.col(c).alias(f"_carried_{i}") for i, c in enumerate(more)]
    out = images.select("frame", "height", "width", "channels", "data", *named)
    return out.mapInArrow(run, ", ".join([f"frame {kind('frame')}, height int, width int, input array<float>", *(f"{c} {kind(c)}" for c in more)]))

"""Palette and pixel colours of label maps, as tables; outlines of boxes."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES, SEED = 150, 42

#: Steps of the table of hues.
HUES = 256
# Where each channel of the table of hues bends, as (place, value); between them it runs straight.
BENDS = {
    "red": ((0, 1), (0.158730, 1), (0.174603, 0.968750), (0.333333, 0.031250), (0.349206, 0), (0.666667, 0), (0.682540, 0.031250), (0.841270, 0.968750), (0.857143, 1), (1, 1)),
    "green": ((0, 0), (0.158730, 0.937500), (0.174603, 1), (0.507937, 1), (0.666667, 0.062500), (0.682540, 0), (1, 0)),
    "blue": ((0, 0), (0.333333, 0), (0.349206, 0.062500), (0.507937, 1), (0.841270, 1), (0.857143, 0.937500), (1, 0.093750)),
}


def hues() -> np.ndarray:
    """The table of hues: HUES rows of red, green and blue in [0, 1], in steps of equal length."""
    at = np.linspace(0, 1, HUES)
    return np.stack([np.interp(at, *zip(*bends, strict=True)) for bends in BENDS.values()], axis=1)


def colours(n: int = CLASSES, seed: int = SEED) -> list[tuple[int, float, float, float]]:
    """(label, r, g, b) in [0, 1]: evenly spaced hues of the table, each times a value drawn from [0.7, 1).

    Two numbers are drawn for each colour and the first isn't used, so that values come out as if
    saturations were drawn too.
    """
    draw, table, out = random.Random(seed), hues(), []
    for i in range(n):
        draw.random()
        value = 0.7 + draw.random() * 0.3
        out.append((i, *(float(c) * value for c in table[int(i / n * HUES)])))
    return out


#: Colour and breadth of a box's outline.
OUTLINE, BREADTH = (255, 0, 0), 3


def outlined(image: np.ndarray, boxes: Sequence[Sequence[float]], colour: Sequence[int] = OUTLINE, breadth: int = BREADTH) -> np.ndarray:
    """A copy of an image (height, width, 3) with the outlines of boxes (x1, y1, x2, y2) in their order.

    Corners are truncated to pixels, which belong to the box; the outline lies inside it. What is beyond the image is
    left out. Boxes that hold a NaN, or whose second corner lies before the first, have no outline.
    """
    out = image.copy()
    height, width = out.shape[:2]
    for box in np.asarray(boxes, np.float64).reshape(-1, 4):
        if np.isnan(box).any() or (box[2:] < box[:2]).any():
            continue
        x1, y1, x2, y2 = (int(v) for v in np.clip(box, -(2**31), 2**31 - 1))
        rows, columns = slice(max(y1, 0), max(min(y2, height - 1) + 1, 0)), slice(max(x1, 0), max(min(x2, width - 1) + 1, 0))
        for k in range(breadth):
            for y in (y1 + k, y2 - k):
                if 0 <= y < height and y1 <= y <= y2:
                    out[y, columns] = colour
            for x in (x1 + k, x2 - k):
                if 0 <= x < width and x1 <= x <= x2:
                    out[rows, x] = colour
    return out


def palette(spark: SparkSession) -> DataFrame:
    """(label, r, g, b) as whole bytes, truncated."""
    return spark.createDataFrame([(i, *(int(c * 255) for c in rgb)) for i, *rgb in colours()], "label int, r int, g int, b int")


def coloured(labels: DataFrame, colour: DataFrame) -> DataFrame:
    """(frame, y, x, r, g, b) of a label map; label 0 and labels beyond the palette are black. Nothing is shuffled."""
    named = colour.filter("label <> 0")
    out = labels.join(F.broadcast(named), "label", "left")  # 150 rows
    return out.select("frame", "y", "x", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def blended(image: DataFrame, overlay: DataFrame) -> DataFrame:
    """Half of each, truncated; background pixels, black in the overlay, come out half as bright."""
    other = overlay.select("frame", "y", "x", *(F.col(c).alias(f"o{c}") for c in "rgb"))
    return image.join(other, ["frame", "y", "x"]).select("frame", "y", "x", *(F.floor(0.5 * F.col(c) + 0.5 * F.col(f"o{c}")).cast("int").alias(c) for c in "rgb"))

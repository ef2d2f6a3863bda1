"""Integer vectors from float ones, exact whatever order they are summed in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def checked(values: np.ndarray, components: int) -> np.ndarray:
    """The values, unless they are so large that sums of `components` squared differences pass 64 bits; then an error."""
    limit = 1 << (62 - max(components, 1).bit_length()) // 2 - 1
    if values.size and max(-int(values.min()), int(values.max())) > limit:
        raise ValueError(f"components beyond {limit} can't be compared exactly in 64 bits")
    return values


def matrix(column: pa.ListArray, components: int) -> np.ndarray:
    """Lists of at most `components` whole numbers as the rows of a matrix; shorter ones are followed by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (sizes == components).all():
        return checked(flat, components).reshape(len(column), components)
    out = np.zeros((len(column), components), np.int64)
    out[np.arange(components) < sizes[:, None]] = flat
    return checked(out, components)

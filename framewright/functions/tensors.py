"""Expressions over array columns that hold a model's outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel means and deviations of the segmentation input.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, even where `use` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def shifted_exp(values: Column) -> Column:
    """exp(v - max): softmax before it is normalised."""
    wide = values.cast("array<double>")
    return bound(F.array_max(wide), lambda top: F.transform(wide, lambda v: F.exp(v - top)))


def softmax(values: Column) -> Column:
    return bound(shifted_exp(values), lambda e: bound(total(e), lambda s: F.transform(e, lambda v: v / s)))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def argmax(values: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def foreground(probabilities: Column) -> Column:
    return F.slice(probabilities, 1, F.size(probabilities) - 1)


def background(probabilities: Column) -> Column:
    return F.element_at(probabilities, -1)


def at_least(value: Column, limit: float, kind: str = "float") -> Column:
    """value >= limit as IEEE has it: never true of NaN, and compared in the column's own precision."""
    return ~F.isnan(value) & (value >= F.lit(limit).cast(kind))


def shown(value: Column, digits: int) -> Column:
    """A number as text with so many decimals, rounded half to even, without marks between thousands."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def scaled(pixel: Column) -> Column:
    """A byte as a float in [0, 1]."""
    return (pixel / 255).cast("float")


def normalised(pixel: Column, channel: int) -> Column:
    return (pixel / 255 - MEAN[channel]) / DEVIATION[channel]

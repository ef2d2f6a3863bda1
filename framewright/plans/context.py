"""Layered template values: later layers win, and each may use what earlier ones set. All are expressions over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordered keys and values; a map column keeps no order.
ENTRIES = "array<struct<key:string,value:string>>"
VALUES = "map<string,string>"
# A template's segments: doubled braces, {name}, any other brace, and the text between them.
_SEGMENT = r"\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}|[{}]|[^{}]+"


def rendered(template: Column, values: Column) -> Column:
    """{key} by its value in the map `values`, a missing key by nothing, {{ and }} by one brace; any other brace is an error. A null template is null."""

    def one(segment: Column) -> Column:
        found = F.when(segment.isin("{{", "}}"), F.substring(segment, 1, 1))
        found = found.when(segment.isin("{", "}"), F.raise_error(F.concat(F.lit("stray brace in "), template)).cast("string"))
        known = F.try_element_at(values, F.substring(segment, 2, F.char_length(segment) - 2))
        return found.when(segment.startswith("{"), F.coalesce(known, F.lit(""))).otherwise(segment)

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(_SEGMENT), 0), one), "")


def folded(values: Column, *layers: Column) -> Column:
    """The map `values` as it is, then each layer's ENTRIES in order, rendered by what stands so far."""
    for layer in layers:
        values = F.aggregate(layer.cast(ENTRIES), values.cast(VALUES), lambda out, e: laid(out, F.create_map(e["key"], rendered(e["value"], out))))
    return values


def laid(under: Column, over: Column) -> Column:
    """Both maps; of keys that both have, the value of `over`."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over).cast(VALUES)


def entries(values: Mapping[str, str]) -> Column:
    """A mapping as ENTRIES, in its order."""
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in values.items())).cast(ENTRIES)


def mapped(layer: Column, values: Column) -> Column:
    """A layer's ENTRIES as a map, each rendered by `values`; of equal keys the last stays."""
    return F.aggregate(layer.cast(ENTRIES), F.create_map().cast(VALUES), lambda out, e: laid(out, F.create_map(e["key"], rendered(e["value"], values))))


def overlay(layers: DataFrame) -> DataFrame:
    """(key, value, layer) of rows (layer, key, value): of each key the value of the highest layer, ties by the larger value."""
    top = layers.groupBy("key").agg(F.max(F.struct("layer", "value")).alias("m"))
    return top.select("key", "m.value", "m.layer")


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (key, value) of `new` that `old` lacks or has otherwise."""
    old = old.select(F.col("key").alias("k"), F.col("value").alias("v"))
    return new.join(old, (F.col("key") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")), "left_anti")

"""Named overlays: rows of a layer, and the base's where the layer has none and inheritance is on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metadata import BASE


def own(rows: DataFrame, layer: str) -> DataFrame:
    return rows.where(F.col("layer") == layer)


def visible(rows: DataFrame, layer: str, inherit: bool, key: str | Sequence[str] = "key") -> DataFrame:
    """The rows(layer, key, ...) that a layer shows: its own, and, if it inherits, the base's of other keys."""
    if not inherit or layer == BASE:
        return own(rows, layer)
    keys = [key] if isinstance(key, str) else list(key)
    mine = own(rows, layer)
    return mine.unionByName(own(rows, BASE).join(mine.select(*keys).distinct(), keys, "left_anti"))


def overlay(base: DataFrame, *layers: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) of base with each layer's values over it, later layers first."""
    out = base.select(key, F.lit(0).alias("_rank"), value)
    for k, layer in enumerate(layers, 1):
        out = out.unionByName(layer.select(key, F.lit(k).alias("_rank"), value))
    return out.groupBy(key).agg(F.max_by(value, "_rank").alias(value))


def layer_keys(rows: DataFrame, layer: str, inherit: bool) -> DataFrame:
    return visible(rows, layer, inherit).select("key").distinct().orderBy("key")


def contains(rows: DataFrame, keys: DataFrame, layer: str, inherit: bool) -> DataFrame:
    """keys(key) with whether the layer shows each."""
    seen = visible(rows, layer, inherit).select("key").distinct().withColumn("_in", F.lit(True))
    return keys.join(seen, "key", "left").select("key", F.coalesce("_in", F.lit(False)).alias("contained"))


def key_in_layer(rows: DataFrame, keys: DataFrame, layer: str) -> DataFrame:
    """keys(key) with whether the layer owns each; inheritance plays no part."""
    return contains(rows, keys, layer, False)

"""Small values that are read as a unit, keyed by (layer, key): table operators, and one value's run-time type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dtypes import require_dtype, supported_numpy

BASE = "__base__"
#: One typed list per storage class; exactly one is not null in a row.
SLOTS = "i array<bigint>, u array<decimal(20,0)>, f array<float>, d array<double>, s array<string>"
SCHEMA = f"layer string, key string, dtype string, shape array<bigint>, v struct<{SLOTS.replace(' array', ':array')}>"


def slot(name: str) -> str:
    return {"uint64": "u", "float32": "f", "float64": "d", "string": "s"}.get(name, "i")


@dataclass(frozen=True)
class MetaValue:
    dtype: str
    shape: tuple[int, ...]
    data: tuple

    @classmethod
    def of(cls, value: object) -> MetaValue:
        if isinstance(value, MetaValue):
            return value
        a, name = supported_numpy(value)
        return cls(name, tuple(a.shape), tuple(a.ravel().tolist()))

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def is_scalar(self) -> bool:
        return self.shape in ((), (1,))

    @property
    def is_array(self) -> bool:
        return not self.is_scalar

    def to_numpy(self) -> np.ndarray:
        return np.array(self.data, object if self.dtype == "string" else self.dtype).reshape(self.shape)

    def as_type(self, name: str) -> np.ndarray:
        require_dtype(self.dtype, name)
        return self.to_numpy()

    def try_as(self, name: str) -> np.ndarray | None:
        return self.to_numpy() if self.dtype == name else None

    def native(self) -> object:
        """A Python scalar for a scalar, a str for one string, else an array."""
        if self.shape == () or (self.dtype == "string" and self.size == 1):
            return self.data[0]
        return self.to_numpy()

    def row(self, layer: str, key: str) -> tuple:
        from decimal import Decimal

        own = slot(self.dtype)
        values = [Decimal(x) for x in self.data] if own == "u" else list(self.data)
        return layer, key, self.dtype, list(self.shape), tuple(values if s == own else None for s in "iufds")

    @classmethod
    def of_row(cls, row) -> MetaValue:
        values = row["v"][slot(row["dtype"])]
        return cls(row["dtype"], tuple(row["shape"]), tuple(int(x) for x in values) if slot(row["dtype"]) == "u" else tuple(values))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("layer", "key")) -> DataFrame:
    """new's rows, and old's where new has none of the key."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def get(meta: DataFrame, key: str, layer: str = BASE) -> DataFrame:
    return meta.where((F.col("layer") == layer) & (F.col("key") == key))


def get_batch(meta: DataFrame, keys: DataFrame, layer: str = BASE) -> DataFrame:
    """The rows of the listed keys(key), in order of key; missing ones are left out."""
    return meta.where(F.col("layer") == layer).join(keys.select("key").distinct(), "key", "left_semi").orderBy("key")


def get_all(meta: DataFrame, layer: str = BASE) -> DataFrame:
    return meta.where(F.col("layer") == layer).orderBy("key")


def remove(meta: DataFrame, keys: DataFrame, layer: str = BASE) -> DataFrame:
    gone = keys.select("key").distinct().withColumn("layer", F.lit(layer))
    return meta.join(gone, ["layer", "key"], "left_anti")


def clear(meta: DataFrame, layer: str = BASE) -> DataFrame:
    return meta.where(F.col("layer") != layer)


def all_keys(meta: DataFrame) -> DataFrame:
    """The distinct keys of all layers, in order."""
    return meta.select("key").distinct().orderBy("key")


def count(meta: DataFrame) -> DataFrame:
    """The number of entries over all layers; a key counts once in each."""
    return meta.agg(F.count("*").alias("n"))


def described(meta: DataFrame) -> DataFrame:
    """(layer, key, dtype, ndim, size, is_scalar) of each entry."""
    n = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    scalar = F.when(F.size("shape") == 1, F.col("shape")[0] == 1).otherwise(F.size("shape") == 0)
    return meta.select("layer", "key", "dtype", F.size("shape").alias("ndim"), n.alias("size"), scalar.alias("is_scalar"))


def of_mapping(values: Mapping[str, object], layer: str = BASE) -> list[tuple]:
    return [MetaValue.of(v).row(layer, k) for k, v in values.items()]

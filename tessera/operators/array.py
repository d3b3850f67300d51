"""An array as a DataFrame of cells (idx, value), with its shape and element type."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import checked, dtype, dtype_of_spark, require_dtype, supported_numpy
from tessera.functions.indexing import coordinate, flat_index, index_range, strides
from tessera.operators.slicing import flat_ranges, merged_runs, normalize, slice_cells

#: Cells that to_numpy and the iterators may bring to the driver, unless forced.
MOST_COLLECTED = 1 << 27


def as_shape(shape: int | Sequence[int]) -> tuple[int, ...]:
    shape = (shape,) if isinstance(shape, int) else tuple(int(n) for n in shape)
    if any(n < 0 for n in shape):
        raise ValueError(f"negative size in {shape}")
    return shape


@dataclass(frozen=True)
class ArrayFrame:
    """Row-major cells; a scalar has shape () and one cell. Immutable: operators return new arrays."""

    cells: DataFrame
    shape: tuple[int, ...]
    dtype: str

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def strides(self) -> list[int]:
        return strides(self.shape)

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 0

    def __repr__(self) -> str:
        return f"ArrayFrame(shape={self.shape}, dtype={self.dtype})"

    def dim(self, k: int) -> int:
        if not 0 <= k < self.ndim:
            raise IndexError(f"dimension {k} of {self.ndim}")
        return self.shape[k]

    def typed(self, name: str) -> ArrayFrame:
        """Itself, if its element type is the one asked for."""
        require_dtype(self.dtype, name)
        return self

    def at(self, *index: int) -> DataFrame:
        """The one cell at a multi-dimensional index."""
        return self.flat(flat_index(index, self.shape))

    def flat(self, k: int) -> DataFrame:
        if not 0 <= k < self.size:
            raise IndexError("flat index out of bounds")
        return self.cells.where(F.col("idx") == k)

    def __getitem__(self, k: int) -> object:
        """The value at a flat index; negative ones count from the end."""
        if not isinstance(k, int) or isinstance(k, bool):
            raise TypeError("a flat index is an int; use slice() for ranges")
        return self.flat(k + self.size if k < 0 else k).first()["value"]

    def coordinates(self) -> DataFrame:
        """Cells with i0, i1, ... beside the flat index."""
        return self.cells.select("idx", *[coordinate(F.col("idx"), k, self.shape).alias(f"i{k}") for k in range(self.ndim)], "value")

    def scan(self, reverse: bool = False) -> DataFrame:
        return self.cells.orderBy(F.desc("idx") if reverse else F.asc("idx"))

    def __iter__(self) -> Iterator[object]:
        for row in self.scan().toLocalIterator():
            yield row["value"]

    def map(self, change: Callable[[Column], Column], name: str | None = None) -> ArrayFrame:
        """Every value changed by an expression."""
        name = name or self.dtype
        return ArrayFrame(self.cells.select("idx", checked(change(F.col("value")), name).alias("value")), self.shape, name)

    def reshape(self, shape: int | Sequence[int]) -> ArrayFrame:
        """The same cells in another shape; no data moves."""
        shape = as_shape(shape)
        if prod(shape) != self.size:
            raise ValueError(f"cannot reshape: {self.size} elements into {shape}")
        return ArrayFrame(self.cells, shape, self.dtype)

    def resize(self, shape: int | Sequence[int], fill: object = None) -> ArrayFrame:
        """The flat sequence cut or filled up to a new shape; coordinates are not kept."""
        shape = as_shape(shape)
        n, cells = prod(shape), self.cells.where(F.col("idx") < prod(shape))
        if n > self.size:
            more = self.cells.sparkSession.range(self.size, n).select(F.col("id").alias("idx"), _literal(fill, self.dtype).alias("value"))
            cells = cells.unionByName(more)
        return ArrayFrame(cells, shape, self.dtype)

    def slice(self, slices: Sequence, allow_nd: bool = False) -> ArrayFrame:
        if self.dtype == "string":
            raise TypeError("unsupported dtype for slicing: string")
        cells, shape = slice_cells(self.cells, self.shape, slices, allow_nd)
        return ArrayFrame(cells, shape, self.dtype)

    def to_numpy(self, force: bool = False) -> np.ndarray:
        if self.size > MOST_COLLECTED and not force:
            raise MemoryError(f"{self.size} elements; pass force=True to bring them to the driver")
        values = self.cells.toPandas().sort_values("idx")["value"]
        kind = object if self.dtype == "string" else np.dtype(self.dtype)
        return np.array([int(v) for v in values] if self.dtype == "uint64" else values.to_numpy(), dtype=kind).reshape(self.shape)

    def checked(self) -> ArrayFrame:
        """Itself, once its cells are known to be exactly 0..size-1; an action."""
        n, low, high, distinct = self.cells.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
        if n != self.size or distinct != n or (n and (low, high) != (0, n - 1)):
            raise ValueError(f"data size does not match the shape {self.shape}")
        return self


def _literal(value: object, name: str) -> Column:
    if value is None:
        value = "" if name == "string" else 0
    return checked(F.lit(str(value)) if name == "uint64" else F.lit(value), name) if name != "uint64" else checked(F.lit(str(int(value))).cast("decimal(20,0)"), name)


def full(spark: SparkSession, shape: int | Sequence[int], value: object, name: str = "float64") -> ArrayFrame:
    shape = as_shape(shape)
    return ArrayFrame(index_range(spark, prod(shape)).select("idx", _literal(value, name).alias("value")), shape, dtype(name).name)


def zeros(spark: SparkSession, shape: int | Sequence[int], name: str = "float64") -> ArrayFrame:
    return full(spark, shape, None, name)


def ones(spark: SparkSession, shape: int | Sequence[int], name: str = "float64") -> ArrayFrame:
    return full(spark, shape, "1" if name == "string" else 1, name)


def empty(spark: SparkSession, shape: int | Sequence[int], name: str = "float64") -> ArrayFrame:
    """Zeros: a DataFrame has no cells without values."""
    return zeros(spark, shape, name)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1, name: str | None = None) -> ArrayFrame:
    """start, start + step, ... below stop, with NumPy's number of elements."""
    if stop is None:
        start, stop = 0, start
    if not step:
        raise ValueError("step 0")
    name = name or ("int64" if all(isinstance(x, int) for x in (start, stop, step)) else "float64")
    n = max(0, math.ceil((stop - start) / step))
    value = F.lit(start) + F.col("idx") * F.lit(step)
    return ArrayFrame(index_range(spark, n).select("idx", checked(value, name).alias("value")), (n,), name)


def from_numpy(spark: SparkSession, values: object) -> ArrayFrame:
    """An array of values on the driver; one cell per element, through Arrow."""
    import pyarrow as pa

    a, name = supported_numpy(values)
    data = a.ravel()
    if name == "uint64":
        column = pa.array([None if v is None else int(v) for v in data.tolist()], pa.decimal128(20, 0))
    else:
        kinds = {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "string": pa.string()}
        column = pa.array(data.tolist() if name == "string" else data, kinds.get(name)) if name == "string" else pa.array(data).cast(kinds.get(name, pa.from_numpy_dtype(data.dtype)))
    table = pa.table({"idx": pa.array(np.arange(len(data), dtype=np.int64)), "value": column})
    return ArrayFrame(spark.createDataFrame(table), tuple(a.shape), name)


def from_table(table: DataFrame, index: str | Column, value: str | Column, shape: int | Sequence[int], name: str | None = None) -> ArrayFrame:
    """A column of a table with a dense index as an array."""
    cells = table.select(F.col(index).cast("bigint").alias("idx") if isinstance(index, str) else index.cast("bigint").alias("idx"), (F.col(value) if isinstance(value, str) else value).alias("value"))
    return ArrayFrame(cells, as_shape(shape), name or dtype_of_spark(cells.schema["value"].dataType.simpleString()))


@dataclass(frozen=True)
class VectorFrame(ArrayFrame):
    """An array whose cells come from one row per vector: slices ask the table only for the rows that they touch."""

    table: DataFrame
    index: str
    vector: str
    width: int

    def reshape(self, shape: int | Sequence[int]) -> ArrayFrame:
        return replace(self, shape=super().reshape(shape).shape)

    def _rows(self, runs: Sequence[tuple[int, int]]) -> ArrayFrame:
        """The same array with the cells of the rows in some runs of rows only."""
        keep = reduce(or_, [F.col(self.index).between(a, b) for a, b in runs])
        return ArrayFrame(_vector_cells(self.table.where(keep), self.index, self.vector, self.width), self.shape, self.dtype)

    def slice(self, slices: Sequence, allow_nd: bool = False) -> ArrayFrame:
        if not self.size:
            return super().slice(slices, allow_nd)
        checked_ = normalize(self.shape, slices, allow_nd)
        return self._rows(merged_runs([(a // self.width, b // self.width) for a, b in flat_ranges(self.shape, checked_)])).slice(slices, allow_nd)

    def flat(self, k: int) -> DataFrame:
        return (self._rows([(k // self.width, k // self.width)]) if 0 <= k < self.size else super()).flat(k)


def _vector_cells(table: DataFrame, index: str, vector: str, width: int) -> DataFrame:
    cells = table.select(F.col(index).cast("bigint").alias("_i"), F.posexplode(vector).alias("_p", "value"))
    return cells.select((F.col("_i") * F.lit(width).cast("bigint") + F.col("_p")).cast("bigint").alias("idx"), "value")


def from_vectors(table: DataFrame, index: str, vector: str, rows: int, width: int) -> ArrayFrame:
    """A column of equally long vectors as an array of rows x width."""
    cells = _vector_cells(table, index, vector, width)
    return VectorFrame(cells, as_shape((rows, width)), dtype_of_spark(cells.schema["value"].dataType.simpleString()), table, index, vector, width)


def dumps(array: ArrayFrame, most: int = 1 << 28) -> bytes:
    """A small array as bytes: number of dimensions, shape, type name, then elements; strings go with their lengths."""
    if array.size * max(8, dtype(array.dtype).size) > most:
        raise MemoryError("too large for one message; write it to a dataset")
    values, name = array.to_numpy(), array.dtype.encode()
    head = np.array([array.ndim, *array.shape], "<u8").tobytes() + bytes([len(name)]) + name
    if array.dtype != "string":
        return head + values.astype(values.dtype.newbyteorder("<")).tobytes()
    texts = [t.encode() for t in values.ravel().tolist()]
    return head + np.array([len(t) for t in texts], "<u4").tobytes() + b"".join(texts)


def loads(spark: SparkSession, data: bytes) -> ArrayFrame:
    """The array that dumps wrote."""
    ndim = int(np.frombuffer(data, "<u8", 1)[0])
    shape = tuple(np.frombuffer(data, "<u8", ndim, 8).astype(int).tolist())
    at = 8 * (ndim + 1)
    name, at = data[at + 1 : at + 1 + data[at]].decode(), at + 1 + data[at]
    n = prod(shape)
    if dtype(name).size:
        if len(data) - at != n * dtype(name).size:
            raise ValueError("data size does not match the shape")
        return from_numpy(spark, np.frombuffer(data, np.dtype(name).newbyteorder("<"), n, at).astype(name).reshape(shape))
    lengths, at, texts = np.frombuffer(data, "<u4", n, at).tolist(), at + 4 * n, []
    for k in lengths:
        texts.append(data[at : at + k].decode())
        at += k
    return from_numpy(spark, np.array(texts, object).reshape(shape))

"""Element types: how each is stored, checked and coerced."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    name: str
    spark: str
    size: int
    low: int | None = None
    high: int | None = None


#: Unsigned types are stored in the next wider signed one, with a range check; strings have no fixed size.
DTYPES = {
    d.name: d
    for d in (
        DType("int8", "tinyint", 1), DType("int16", "smallint", 2), DType("int32", "int", 4), DType("int64", "bigint", 8),
        DType("uint8", "smallint", 1, 0, 2**8 - 1), DType("uint16", "int", 2, 0, 2**16 - 1), DType("uint32", "bigint", 4, 0, 2**32 - 1), DType("uint64", "decimal(20,0)", 8, 0, 2**64 - 1),
        DType("float32", "float", 4), DType("float64", "double", 8), DType("string", "string", 0),
    )
}
_OF_SPARK = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "decimal(20,0)": "uint64", "float": "float32", "double": "float64", "string": "string"}


def dtype(name: str) -> DType:
    if name not in DTYPES:
        raise ValueError(f"unsupported dtype {name!r}; one of {', '.join(DTYPES)}")
    return DTYPES[name]


def dtype_of_spark(simple: str) -> str:
    """The element type that a Spark column type holds by default."""
    if simple not in _OF_SPARK:
        raise TypeError(f"no element type for a column of type {simple}")
    return _OF_SPARK[simple]


def checked(value: Column, name: str) -> Column:
    """value in the storage type of a dtype; raises on nulls and on numbers out of range (casts raise in ANSI mode)."""
    d = dtype(name)
    wrong = value.isNull()
    if d.low is not None:
        wrong = wrong | (value < F.lit(d.low)) | (value > F.lit(str(d.high)).cast("decimal(20,0)"))
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"not a {name}: "), F.coalesce(value.cast("string"), F.lit("null"))))).otherwise(value).cast(d.spark)


def require_dtype(found: str, wanted: str) -> None:
    if found != wanted:
        raise TypeError(f"type mismatch: the array is {found}, {wanted} was asked for")


def supported_numpy(values: object) -> tuple[np.ndarray, str]:
    """An array of one of the dtypes, and its name: other numbers become float64, text becomes strings."""
    a = np.asarray(values)
    if a.dtype.kind in "USO":
        return np.vectorize(lambda x: x.decode() if isinstance(x, bytes) else str(x), otypes=[object])(a) if a.size else a.astype(object), "string"
    if a.dtype.kind == "c":
        warnings.warn("the imaginary part is dropped", stacklevel=2)
        a = a.real
    if not a.dtype.isnative:
        a = a.astype(a.dtype.newbyteorder("="))
    if a.dtype.name not in DTYPES:
        a = a.astype(np.float64)
    return a, a.dtype.name


def cells_checked(cells: DataFrame, name: str) -> DataFrame:
    return cells.select(F.col("idx").cast("bigint").alias("idx"), checked(F.col("value"), name).alias("value"))

"""Row-major index arithmetic, and byte planes of integers, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strides(shape: Sequence[int]) -> list[int]:
    """Elements to step over per dimension; the last dimension steps by one."""
    return [prod(shape[k + 1 :]) for k in range(len(shape))]


def flat_index(index: Sequence[int], shape: Sequence[int]) -> int:
    if len(index) != len(shape) and not (not shape and list(index) == [0]):
        raise ValueError(f"{len(index)} indexes for {len(shape)} dimensions")
    for k, (i, n) in enumerate(zip(index, shape, strict=False)):
        if not 0 <= i < n:
            raise IndexError(f"index {i} is out of bounds for dimension {k} of size {n}")
    return sum(i * s for i, s in zip(index, strides(shape), strict=False))


def coordinate(idx: Column, k: int, shape: Sequence[int]) -> Column:
    """The index along dimension k of a flat index: (idx div stride) mod size, in BIGINT arithmetic."""
    step = strides(shape)[k]
    whole = F.call_function("div", idx, F.lit(step).cast("bigint")) if step > 1 else idx
    return whole % F.lit(shape[k]).cast("bigint") if k else whole


def byte_plane(value: Column, plane: int) -> Column:
    """Byte ``plane`` (0: least significant) of an integer."""
    return F.shiftright(value.cast("bigint"), 8 * plane).bitwiseAND(F.lit(255).cast("bigint"))


def byte_planes(cells: DataFrame, size: int) -> DataFrame:
    """(plane, idx, byte) of integer cells(idx, value): the array's bytes, plane after plane."""
    planes = F.array(*[F.struct(F.lit(k).cast("bigint").alias("plane"), byte_plane(F.col("value"), k).alias("byte")) for k in range(size)])
    return cells.select("idx", F.explode(planes).alias("p")).select("p.plane", "idx", "p.byte")


def from_byte_planes(planes: DataFrame) -> DataFrame:
    """cells(idx, value) of the 8-byte integers whose planes are given."""
    shifted = F.call_function("shiftleft", F.col("byte"), (F.col("plane") * 8).cast("int"))
    return planes.groupBy("idx").agg(F.sum(shifted).alias("value"))


def with_row_index(rows: DataFrame, name: str = "idx") -> DataFrame:
    """rows with a dense 0-based number in their present order, without a window over all rows.

    One job counts the rows of each partition; the counts (a row for each partition) are summed up and joined back.
    The input must give the same partitions when read again, as files do.
    """
    at = F.monotonically_increasing_id()
    marked = rows.withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_part", F.shiftright(at, 33))
    counts = rows.select(F.spark_partition_id().cast("bigint").alias("_part")).groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return marked.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def index_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"))

"""Strided rectangular slices of arrays of up to three dimensions.

A slice is a filter and a projection: per-dimension conditions on the coordinates of the flat index, and the index in
the output's shape. Catalyst can't turn conditions on ``(idx div stride) % size`` round, so the range of flat indexes
that they imply is added, and reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.indexing import coordinate, strides

MOST_DIMENSIONS = 3
#: Up to so many runs of rows, the exact ranges are pushed down instead of their hull.
MOST_RUNS = 64


@dataclass(frozen=True)
class Slice:
    """Half-open, without negative numbers."""

    start: int
    stop: int
    step: int = 1

    def __post_init__(self) -> None:
        if min(self.start, self.stop) < 0 or self.step < 0:
            raise ValueError(f"negative numbers in {self}")

    def __len__(self) -> int:
        return 0 if not self.step or self.stop <= self.start else -(-(self.stop - self.start) // self.step)

    @property
    def last(self) -> int:
        return self.start + (len(self) - 1) * self.step


def slice_all(n: int) -> Slice:
    return Slice(0, n)


def slice_range(start: int, stop: int) -> Slice:
    return Slice(start, stop)


def normalize(shape: Sequence[int], slices: Sequence, allow_nd: bool = False) -> list[Slice]:
    """One checked Slice per dimension; missing trailing ones are whole."""
    if not shape:
        raise ValueError("a scalar has no dimension to slice")
    if len(shape) > MOST_DIMENSIONS and not allow_nd:
        raise ValueError(f"slicing takes up to {MOST_DIMENSIONS} dimensions, not {len(shape)}")
    if len(slices) > len(shape):
        raise ValueError(f"{len(slices)} slices for {len(shape)} dimensions")
    out = [s if isinstance(s, Slice) else Slice(*s) for s in slices] + [slice_all(n) for n in shape[len(slices) :]]
    for k, (s, n) in enumerate(zip(out, shape, strict=True)):
        if not s.step:
            raise ValueError(f"step 0 in dimension {k}")
        if (s.start >= n or s.stop > n or s.start >= s.stop) and not (k >= len(slices) and n == 0):
            raise ValueError(f"slice out of bounds for dimension {k}")
    return out


def flat_ranges(shape: Sequence[int], slices: Sequence[Slice]) -> list[tuple[int, int]]:
    """Inclusive ranges of flat indexes that hold the slice: exact runs where they are few, else their hull."""
    step = strides(shape)
    first = sum(s.start * t for s, t in zip(slices, step, strict=True))
    last = sum(s.last * t for s, t in zip(slices, step, strict=True))
    inner = len(shape) - 1  # the outermost dimension from which on all is one run
    while inner and slices[inner].start == 0 and slices[inner].last == shape[inner] - 1 and slices[inner].step == 1:
        inner -= 1
    outer = slices[:inner]
    if not 1 < prod(len(s) for s in outer) <= MOST_RUNS:
        return [(first, last)]
    starts = [0]
    for s, t in zip(outer, step, strict=False):
        starts = [a + i * t for a in starts for i in range(s.start, s.stop, s.step)]
    low = sum(s.start * t for s, t in zip(slices[inner:], step[inner:], strict=True))
    high = sum(s.last * t for s, t in zip(slices[inner:], step[inner:], strict=True))
    return [(a + low, a + high) for a in starts]


def predicate(idx: Column, shape: Sequence[int], slices: Sequence[Slice]) -> Column:
    """The condition on a flat index to be in the slice, with the implied ranges first."""
    ranges = flat_ranges(shape, slices)
    keep = (idx >= ranges[0][0]) & (idx <= ranges[-1][1])
    if len(ranges) > 1:
        exact = (idx >= ranges[0][0]) & (idx <= ranges[0][1])
        for a, b in ranges[1:]:
            exact = exact | ((idx >= a) & (idx <= b))
        keep = keep & exact
    for k, s in enumerate(slices):
        if s.start or s.stop < shape[k] or s.step > 1:
            i = coordinate(idx, k, shape)
            keep = keep & (i >= s.start) & (i < s.stop)
            if s.step > 1:
                keep = keep & ((i - s.start) % F.lit(s.step).cast("bigint") == 0)
    return keep


def out_index(idx: Column, shape: Sequence[int], slices: Sequence[Slice]) -> Column:
    """The flat index in the slice's own shape."""
    out = F.lit(0).cast("bigint")
    for k, (s, t) in enumerate(zip(slices, strides([len(s) for s in slices]), strict=True)):
        i = coordinate(idx, k, shape) - F.lit(s.start).cast("bigint")
        if s.step > 1:
            i = F.call_function("div", i, F.lit(s.step).cast("bigint"))
        out = out + i * F.lit(t).cast("bigint")
    return out


def slice_cells(cells: DataFrame, shape: Sequence[int], slices: Sequence, allow_nd: bool = False) -> tuple[DataFrame, tuple[int, ...]]:
    """The cells(idx, value) of a slice under their new index, and its shape."""
    checked = normalize(shape, slices, allow_nd)
    if not prod(shape):
        return cells.limit(0), tuple(len(s) for s in checked)
    kept = cells.where(predicate(F.col("idx"), shape, checked))
    return kept.select(out_index(F.col("idx"), shape, checked).alias("idx"), "value"), tuple(len(s) for s in checked)


def block_ranges(shape: Sequence[int], slices: Sequence, elements_per_block: int) -> list[tuple[int, int]]:
    """The blocks that hold the slice's implied ranges, as (first, last) runs: MOST_RUNS at most, however many blocks."""
    if elements_per_block < 1:
        raise ValueError("the block is too small for an element")
    return merged_runs([(a // elements_per_block, b // elements_per_block) for a, b in flat_ranges(shape, normalize(shape, slices, True))])


def merged_runs(runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) runs in order, with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(spark: SparkSession, runs: Sequence[tuple[int, int]]) -> DataFrame:
    """(block_id) of the blocks of some runs; only the runs are on the driver."""
    return spark.createDataFrame(list(runs), "first bigint, last bigint").select(F.explode(F.sequence("first", "last")).alias("block_id"))


def block_map(shape: Sequence[int], slices: Sequence, elements_per_block: int) -> list[int]:
    """The numbers of those blocks, for small slices."""
    return [b for first, last in block_ranges(shape, slices, elements_per_block) for b in range(first, last + 1)]


def block_runs(blocks: Sequence[int]) -> list[tuple[int, int]]:
    """Neighbouring blocks as (first, last) runs, each one read."""
    return merged_runs([(b, b) for b in set(blocks)])

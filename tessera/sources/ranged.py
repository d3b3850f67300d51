"""Arrays that lie as raw little-endian elements behind HTTP or in a file: ranged reads of the blocks a slice needs."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import checked, dtype
from tessera.operators.array import ArrayFrame, as_shape
from tessera.operators.codec import DEFAULT_BLOCK, elements_per_block
from tessera.operators.slicing import block_ranges, slice_cells
from tessera.sources.paths import parse_path

#: A run of neighbouring blocks is one request, up to this many bytes.
REQUEST_BYTES = 1 << 26


def fetch(url: str, start: int, stop: int) -> bytes:
    """Bytes start to stop of a URL (one ranged GET) or of what a file system of pyarrow reads."""
    if parse_path(url).kind == "http":
        request = urllib.request.Request(parse_path(url).uri, headers={"Range": f"bytes={start}-{stop - 1}"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            data = answer.read()
        return data if answer.status == 206 else data[start:stop]
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(url)
    with files.open_input_file(path) as source:
        source.seek(start)
        return source.read(stop - start)


def _cells(url: str, name: str, n: int):
    size = dtype(name).size

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stop = min(last, n)
                values = np.frombuffer(fetch(url, first * size, stop * size), np.dtype(name).newbyteorder("<")).astype(name)
                if len(values) != stop - first:
                    raise EOFError(f"{url} ends before element {stop}")
                wide = pa.array([int(v) for v in values], pa.decimal128(20, 0)) if name == "uint64" else pa.array(values).cast({"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64()}.get(name, pa.from_numpy_dtype(values.dtype)))
                for at in range(0, len(values), 1 << 16):
                    part = wide.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part), dtype=np.int64)), part], names=["idx", "value"])

    return per_partition


def open_ranged(spark: SparkSession, url: str, shape: int | Sequence[int], name: str, slices: Sequence = (), block_bytes: int = DEFAULT_BLOCK) -> ArrayFrame:
    """The slice of a remote array; only the blocks that it touches are asked for, a request per run of blocks.

    Runs are dealt to tasks, so requests go out from the executors, in parallel; no request asks for sizes first.
    """
    shape, size = as_shape(shape), dtype(name).size
    if not size:
        raise TypeError("strings have no fixed size")
    n, per_block = int(np.prod(shape)), elements_per_block(block_bytes, name)
    most = max(1, REQUEST_BYTES // (per_block * size))
    runs = spark.createDataFrame(block_ranges(shape, slices, per_block), "a bigint, b bigint")
    runs = runs.select("b", F.explode(F.sequence("a", "b", F.lit(most).cast("bigint"))).alias("block"))
    end = F.least(F.col("block") + F.lit(most), F.col("b") + F.lit(1))
    asked = runs.select((F.col("block") * per_block).alias("first"), (end * per_block).alias("last")).repartition(spark.sparkContext.defaultParallelism)
    cells = asked.mapInArrow(_cells(url, name, n), f"idx bigint, value {dtype(name).spark}")
    cells = cells.select("idx", checked(F.col("value"), name).alias("value"))
    return ArrayFrame(*slice_cells(cells, shape, slices), name)

"""Codecs, blocks and byte shuffling."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dtypes import dtype

#: Codec names and what Parquet calls the codec under them. zstd is reserved and refused.
PARQUET = {"none": "uncompressed", "gzip": "gzip", "lz4": "lz4_raw", "gzip_shuffle": "gzip", "lz4_shuffle": "lz4_raw"}
DEFAULT_BLOCK = 1 << 20
MOST_KEYS = 1 << 16


def parquet_codec(codec: str) -> str:
    if codec == "zstd":
        raise ValueError("zstd is reserved and not supported")
    if codec not in PARQUET:
        raise ValueError(f"unknown codec {codec!r}; one of {', '.join(PARQUET)}")
    return PARQUET[codec]


def base_codec(codec: str) -> str:
    parquet_codec(codec)
    return codec.removesuffix("_shuffle")


def uses_shuffle(codec: str) -> bool:
    parquet_codec(codec)
    return codec.endswith("_shuffle")


def elements_per_block(block_bytes: int, name: str) -> int:
    n = block_bytes // max(1, dtype(name).size)
    if n < 1:
        raise ValueError("block size too small for element type")
    return n


def shuffled(data: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second bytes, and so on."""
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes() if size > 1 else data


def unshuffled(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes() if size > 1 else data


#: Blocks of a shuffled array as they are stored: the bytes of n elements, plane after plane.
PLANES = "array_id bigint, block bigint, n bigint, planes binary"
_WIDER = {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0)}


def pack_planes(name: str, per_block: int):
    """(array_id, idx, value) in order as PLANES; a task gets whole blocks."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, name)

        def packed(upto: int) -> Iterator[pa.RecordBatch]:
            block = places[:upto] // per_block
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (ids[1:upto] != ids[: upto - 1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (places[a:b] != block[a] * per_block + np.arange(b - a)).any():
                    raise ValueError(f"cells are missing or twice in the block from {block[a] * per_block}")
                data = shuffled(values[a:b].tobytes(), values.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(ids[a]), int(block[a]), b - a, data)], names=["array_id", "block", "n", "planes"])

        for batch in batches:
            fresh = batch.column(2)
            fresh = np.array([int(v) for v in fresh.to_pylist()], name) if name == "uint64" else fresh.to_numpy(zero_copy_only=False).astype(name)
            ids, places, values = (np.concatenate(x) for x in ((ids, batch.column(0).to_numpy()), (places, batch.column(1).to_numpy()), (values, fresh)))
            if len(ids):  # the last block may go on
                block = places // per_block
                ends = np.flatnonzero((ids[1:] != ids[:-1]) | (block[1:] != block[:-1]))
                last = int(ends[-1]) + 1 if len(ends) else 0
                if last:
                    yield from packed(last)
                ids, places, values = ids[last:], places[last:], values[last:]
        if len(ids):
            yield from packed(len(ids))

    return per_partition


def unpack_planes(name: str, per_block: int):
    """PLANES as (array_id, idx, value)."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for array_id, block, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                data = np.frombuffer(unshuffled(planes.as_py(), np.dtype(name).itemsize), name)
                value = pa.array([int(v) for v in data], _WIDER[name]) if name == "uint64" else pa.array(data).cast(_WIDER.get(name, pa.from_numpy_dtype(data.dtype)))
                idx = block * per_block + np.arange(len(data), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), array_id)), pa.array(idx), value], names=["array_id", "idx", "value"])

    return per_partition


def with_block(cells: DataFrame, per_block: int) -> DataFrame:
    return cells.withColumn("block_id", F.call_function("div", F.col("idx"), F.lit(per_block).cast("bigint")))


def block_map(cells: DataFrame, per_block: int) -> DataFrame:
    """(block_id, n, first, last) of each block that has cells."""
    return with_block(cells, per_block).groupBy("block_id").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def squeeze(data: bytes, codec: str, size: int) -> bytes:
    """A block as the codec stores it."""
    data = shuffled(data, size) if uses_shuffle(codec) else data
    if base_codec(codec) == "gzip":
        return zlib.compress(data, 9)
    if base_codec(codec) == "lz4":
        return pa.Codec("lz4_raw").compress(data, asbytes=True)
    return data


def block_sizes(cells: DataFrame, name: str, codec: str, block_bytes: int = DEFAULT_BLOCK) -> DataFrame:
    """(block_id, uncompressed, compressed) bytes of the blocks of numeric cells, by really compressing each."""
    d = dtype(name)
    if name == "string":
        raise TypeError("strings have no fixed size")
    parquet_codec(codec)
    per_block = elements_per_block(block_bytes, name)

    def measured(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("idx")["value"]
        data = np.array([int(v) for v in values] if name == "uint64" else values.to_numpy(), dtype=name).tobytes()
        return pd.DataFrame({"block_id": [group["block_id"].iloc[0]], "uncompressed": [len(data)], "compressed": [len(squeeze(data, codec, d.size))]})

    return with_block(cells, per_block).groupBy("block_id").applyInPandas(measured, "block_id bigint, uncompressed bigint, compressed bigint")


def codec_parity(cells: DataFrame, name: str, codecs: Iterable[str], block_bytes: int = DEFAULT_BLOCK) -> DataFrame:
    """(codec, total) compressed bytes of the same cells under several codecs, from one pass over the blocks."""
    codecs, size = list(codecs), dtype(name).size

    def measured(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("idx")["value"]
        data = np.array([int(v) for v in values] if name == "uint64" else values.to_numpy(), dtype=name).tobytes()
        return pd.DataFrame({"codec": codecs, "compressed": [len(squeeze(data, codec, size)) for codec in codecs]})

    blocks = with_block(cells, elements_per_block(block_bytes, name)).groupBy("block_id").applyInPandas(measured, "codec string, compressed bigint")
    return blocks.groupBy("codec").agg(F.sum("compressed").alias("total"))

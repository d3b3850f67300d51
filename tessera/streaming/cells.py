"""Cells arriving as a stream: idempotent appends, and running block statistics with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.dtypes import cells_checked, dtype
from tessera.operators.codec import with_block


def append_cells(stream: DataFrame, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of cells(idx, value) as Parquet below path, each micro-batch once; runs until what is there is read."""
    dtype(name)
    return cells_checked(stream, name).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_cells(cells: DataFrame, order: str) -> DataFrame:
    """One value per index, the last by ``order``, of cells that were written several times."""
    return cells.groupBy("idx").agg(F.max_by("value", order).alias("value"))


def block_statistics(stream: DataFrame, per_block: int, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window of event time and block: number, least and greatest value; cells later than the watermark are dropped."""
    blocks = with_block(stream.withWatermark(time, late), per_block)
    return blocks.groupBy(F.window(time, window), "block_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))

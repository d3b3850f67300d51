"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Keys with fewer rows than this are never hot.
HOT_LEAST = 64


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def work_uri(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``; a temporary one where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(uri)
    return uri


def drop_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Deletes the work folders that were asked for inside; what is to stay must be written elsewhere before the end."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for uri in made:
            drop_folder(spark, uri)


def materialize(df: DataFrame, uri: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: list[str]) -> DataFrame:
    """Left join to a side that is unique by key, when some keys hold a large share of left's rows.

    ``weight`` is right's column with the number of left rows of its key. Hot keys are those above HOT_SHARE of all
    rows; there can be at most 1 / HOT_SHARE of them, so that part of right is broadcast at a proven size. The other
    keys go through an ordinary shuffle join, where hot rows get a second key made of the ``spread`` columns and so
    are dealt out evenly. right should be a written table: it is read twice.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.sum(weight)).first()[0] or 0
    cut = max(HOT_LEAST, total * HOT_SHARE)
    hot = right.where(F.col(weight) >= cut).select(key, F.struct(*values).alias("_hot"))
    cold = right.where(F.col(weight) < cut).select(key, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread).bitwiseOR(F.lit(1))))
    joined = salted.join(cold, [key, "_salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values])


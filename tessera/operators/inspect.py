"""Catalog inspection: totals, histograms, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRINT_LIMIT = 2 << 30
PREVIEW = 100


def elements() -> Column:
    return F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)


def summary(catalog: DataFrame) -> DataFrame:
    """Number of arrays, elements (a scalar is one) and bytes."""
    return catalog.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(elements()), F.lit(0)).alias("n_elements"), F.coalesce(F.sum(elements() * F.col("elem_size")), F.lit(0)).alias("n_bytes"))


def codec_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("codec").agg(F.count("*").alias("n"))


def block_histogram(catalog: DataFrame) -> DataFrame:
    """Arrays by the uncompressed bytes of their first block."""
    first = F.least(elements() * F.col("elem_size"), F.col("block_bytes"))
    return catalog.groupBy(first.alias("first_block_bytes")).agg(F.count("*").alias("n"))


def listing(catalog: DataFrame) -> DataFrame:
    """Keys in order of insertion, with type, shape, elements, bytes and blocks."""
    n = elements()
    blocks = F.ceil(n * F.col("elem_size") / F.col("block_bytes"))
    return catalog.select("layer", "key", "dtype", "shape", n.alias("n_elements"), (n * F.col("elem_size")).alias("n_bytes"), blocks.alias("n_blocks"), "codec", "ord").orderBy("ord")


def shortened(text: Column, most: int = 40) -> Column:
    """Texts above ``most`` characters cut, with three dots for the rest."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def preview(values: Column, text: bool) -> Column:
    """One value as itself, up to five (texts: three) as a list, more as their number."""
    n = F.size(values)
    one = shortened(values[0]) if text else values[0].cast("string")
    short = F.transform(values, lambda x: shortened(x, 20) if text else x.cast("string"))
    listed = F.concat(F.lit("["), F.array_join(short, ", "), F.lit("]"))
    return F.when(n == 1, one).when(n <= (3 if text else 5), listed).otherwise(F.concat(F.lit("["), n.cast("string"), F.lit(" elements]")))


def head(cells: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first cells in order; an index filter rather than a sort of the array."""
    return cells.where(F.col("idx") < n)


def printed(values: list, total: int, text: bool) -> str:
    """Ten a line, floats with three decimals, and how many more there are."""
    show = [repr(v) if text else f"{v:.3f}" if isinstance(v, float) else str(v) for v in values[:PREVIEW]]
    lines = [", ".join(show[i : i + 10]) for i in range(0, len(show), 10)]
    return "\n".join(lines + ([f"... ({total - len(show)} more)"] if total > len(show) else []))

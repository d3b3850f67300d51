"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document's expected copies (its source's target divided by its source's size) are prefix-summed within its
source, the source's one random offset is added, and a document is emitted once per integer boundary that its own
interval crosses. Documents are summed in order of size, so that the words taken, too, come near the target.

The prefix sum is distributed: rows are range-partitioned by (source, size, doc_id), numbered within their partitions,
and only one count per source and partition is summed over a window.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order; a source of size 0
gets target 0 and no copies; repeated rows and ids count each for itself (their order among themselves does not
matter, as they are equal in size); an empty table gives an empty result. Other columns are ignored by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, work_uri

WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes(source, source_size, ...) with each source's target: water-filling under a limit of ``most`` times its size.

    Sources are weighted in order of code points, null last. Sorted by limit over weight, the sources that reach their
    limit are a prefix, so two running sums decide them all; there is one row per source here.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("_k", F.row_number().over(order)).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_k") - 1, F.lit(n)) + 1).cast("int")))
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_fill, whole = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k")), Window.partitionBy()
    level = (F.col("_goal") - F.col("_caps")) / F.col("_weights")
    filled = weighted.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("_w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_goal": F.sum("source_size").over(whole) * F.lit(float(share)),
    }).withColumn("_level", F.max(F.when(level * F.col("_w") < F.col("_cap"), level)).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return filled.withColumn("target", target).select(*sizes.columns, "target")


def offset(seed: int) -> Column:
    """The source's random offset in [0, 1): the first 32 bits of a digest of its name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows (a written table) with ``rank``: each row's 0-based place within its group, without any group in one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col(group).asc_nulls_last(), *order).sortWithinPartitions(F.col(group).asc_nulls_last(), *order)
    at = F.monotonically_increasing_id()
    dealt = materialize(dealt.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).drop("_at").withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))), work_uri(spark, "numbered"))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_start")
    joined = dealt.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("rank", F.col("_row") + F.col("_start")).drop("_row", "_part", "_g", "_p", "_start")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source)."""
    return _mix(docs.select("doc_id", "source", word_count().alias("size")), weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept.

    Rows are told apart by their place in a written table, so repeated ids and rows are taken each for itself.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    by = dict(zip(docs.columns, names, strict=True))
    rows = materialize(docs.toDF(*names).withColumn("_place", F.monotonically_increasing_id()), work_uri(docs.sparkSession, "mix-rows"))
    sized = rows.select("_place", F.col(by["doc_id"]).alias("doc_id"), F.col(by["source"]).alias("source"), word_count(by["text"]).alias("size"))
    taken = _mix(sized, weights, share, most, seed).where("copies > 0").select("_place", "copies")
    copied = rows.join(taken, "_place").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copied.select(*[F.col(n).alias(c) for c, n in by.items()])


def _mix(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target, copies and taken."""
    uri = work_uri(docs.sparkSession, "mix")
    sized = materialize(docs, f"{uri}/sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most).withColumn("_u", offset(seed)), f"{uri}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target", rate.alias("_rate"), "_u")
    rows = numbered(sized, "source", ["size", "doc_id"]).join(goals, F.col("source").eqNullSafe(F.col("_s")))
    upto = lambda rank: F.floor(rank * F.col("_rate") + F.col("_u"))
    copies = (upto(F.col("rank") + 1) - upto(F.col("rank"))).cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))

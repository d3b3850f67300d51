"""Parallelism of a session, and what a plan reads."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Bytes that one task should read or shuffle.
TASK_BYTES = 1 << 27


def set_tasks(spark: SparkSession, n: int = 0) -> int:
    """Use n tasks per shuffle; 0 takes the session's default parallelism, 1 runs serially."""
    if n < 0:
        raise ValueError(f"{n} tasks")
    n = n or spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def get_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(n_bytes: int) -> int:
    """Tasks for an input of so many bytes."""
    return max(1, -(-n_bytes // TASK_BYTES))


@dataclass(frozen=True)
class Plan:
    """What the physical plan of a DataFrame says before it runs."""

    files: int
    columns: tuple[str, ...]
    pushed: tuple[str, ...]
    shuffles: int
    python: int


def plan_of(df: DataFrame) -> Plan:
    """Files of the scans, their columns and pushed filters, and the number of shuffles and Python operators."""
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, "100000")  # else long lists of filters are cut
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)
    columns = [c.split(":")[0] for x in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in x.split(",") if c]
    pushed = [f for x in re.findall(r"PushedFilters: \[([^\]]*)\]", text) for f in re.split(r"(?<=\)), ", x) if f]
    return Plan(len(df.inputFiles()), tuple(dict.fromkeys(columns)), tuple(dict.fromkeys(pushed)), len(re.findall(r"\bExchange ", text)), len(re.findall(r"\b(?:MapInArrow|MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)\b", text)))

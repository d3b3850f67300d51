"""Connected components by alternating large-star and small-star rounds, as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skew_join, work_uri

#: Edges of a task, on average; and at most so many are contracted together.
TASK_EDGES = 250_000
MOST_EDGES = 1 << 20


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node of the edges that is not the smallest one it is connected with by them."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(i):
        x, y = root[i], root[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning_stars(table.column(0).to_numpy(), table.column(1).to_numpy())], names=["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, MOST_EDGES):
            part = batch.slice(at, MOST_EDGES)
            if held and rows + part.num_rows > MOST_EDGES:
                yield stars()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield stars()


def _contracted(edges: DataFrame, uri: str, tasks: int | None = None) -> DataFrame:
    """edges(a, b) written, after each task put stars in place of its own edges; what is connected stays so."""
    edges = edges if tasks is None else edges.coalesce(tasks)
    return materialize(edges.select("a", "b").mapInArrow(_contract, "a long, b long"), uri)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one edge, to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups = 1 and n > 1)").isEmpty()


def _star(edges: DataFrame, uri: str, large: bool, tasks: int) -> DataFrame:
    """edges(a, b), a > b. Large: larger neighbours move to the node's minimum; small: smaller neighbours do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(tasks), f"{uri}-min")
    joined = skew_join(both, least, "u", "n", ["u", "v"]).coalesce(tasks).withColumn("m", F.least("m", "u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
    moved = moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return _contracted(moved, uri, tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the smallest node reachable. Loops and repeats are ignored.

    Tasks first put stars in place of the edges that they hold, at most MOST_EDGES at a time, which leaves fewer edges
    than nodes; rounds of stars over the shuffled edges join those until every node has one edge, to a root. The edges
    are written to the shared folder after every star, so a lost executor costs one round. Rounds grow with the
    logarithm of the number of nodes, tasks with the number of edges. No node's neighbours are ever gathered: minima
    are aggregated before the shuffle, and hubs are joined by skew_join.
    """
    uri = work_uri(edges.sparkSession, "components")
    now = _contracted(edges.where("a <> b"), f"{uri}/loose")
    tasks = 1 + now.count() // TASK_EDGES
    now, k = _contracted(now.distinct(), f"{uri}/0", tasks), 0
    while not _are_stars(now):
        k += 1
        now = _star(_star(now, f"{uri}/{k}-large", True, tasks), f"{uri}/{k}-small", False, tasks)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

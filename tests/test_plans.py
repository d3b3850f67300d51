"""The plans that the operators make: what is pushed down, shuffled and run in Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera
from tessera.functions.runtime import get_tasks, plan_of, set_tasks, tasks_for
from tessera.operators import layers, metadata
from tessera.operators.array import from_table
from tessera.plans import queries


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('plans')}/d"
    with tessera.create(spark, path, tessera.Config(codec="none")) as ds:
        ds["x"] = np.arange(300_000).reshape(300, 1000)
        ds["y"] = np.arange(300_000)
    return tessera.open_dataset(spark, path)


def test_slices_push_ranges_and_shuffle_nothing(stored):
    for key, spec in (("x", [(5, 9), (10, 20)]), ("x", [(0, 300, 100)]), ("y", [(7, 900, 3)])):
        plan = plan_of(stored.get_slice(key, spec).cells)
        assert plan.files == 1 and plan.shuffles == 0 and plan.python == 0
        assert any("GreaterThanOrEqual(idx" in f for f in plan.pushed) and any("LessThanOrEqual(idx" in f for f in plan.pushed)
        assert set(plan.columns) == {"array_id", "idx", "value"}


def test_runs_of_rows_are_pushed_exactly(stored):
    plan = plan_of(stored.get_slice("x", [(0, 300, 100), (0, 10)]).cells)
    assert any(f.startswith("Or(") or "Or(" in f for f in plan.pushed)


def test_columns_are_pruned(spark, stored):
    assert "value" not in plan_of(stored["y"].cells.select("idx")).columns
    table = stored["y"].cells
    narrow = from_table(table, "idx", "value", 300_000).reshape((300, 1000)).map(lambda v: v + 1)
    assert plan_of(narrow.cells).shuffles == 0


def test_layers_take_one_join(spark, stored):
    rows = stored["y"].cells.select(F.when(F.col("idx") % 3 == 0, "a").otherwise(metadata.BASE).alias("layer"), (F.col("idx") % 1000).alias("key"), "value")
    plan = plan_of(layers.overlay(layers.own(rows, metadata.BASE), layers.own(rows, "a")))
    assert plan.shuffles <= 1 and plan.python == 0


def test_tasks(spark):
    before = get_tasks(spark)
    assert set_tasks(spark, 3) == get_tasks(spark) == 3 and set_tasks(spark) == spark.sparkContext.defaultParallelism
    set_tasks(spark, before)
    assert tasks_for(0) == 1 and tasks_for((1 << 27) + 1) == 2
    with pytest.raises(ValueError):
        set_tasks(spark, -1)


def test_vector_slices_read_only_their_rows(spark):
    """The row range is pushed to the scan, below the explode."""
    plan = queries.QUERIES["slice_2d_sub"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "LessThanOrEqual(vec_id,19)" in plan

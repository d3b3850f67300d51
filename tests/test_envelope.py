"""Export of arrays in rows of bounded size."""

import json
import os

import pytest

import __spark_entry__ as entry
import tessera
from tessera.operators import convert

SF = "/root/testdata/sf0.001"


def test_blocks_are_bounded(spark):
    rows = sorted(convert.envelope_blocks(tessera.arange(spark, 2500).reshape((50, 50)), 1000).collect())
    parts = [json.loads(r.json) for r in rows]
    assert [r.block for r in rows] == [0, 1, 2, 3] and parts[0] == {"dtype": "int64", "shape": [50, 50], "blocks": 3}
    assert [len(p["data"]) for p in parts[1:]] == [1000, 1000, 500] and [x for p in parts[1:] for x in p["data"]] == list(range(2500))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["json_envelope_orders", "csv_export_orders"])
def test_whole_table_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    got = entry.queries()[name](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())

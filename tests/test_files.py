"""JSON and CSV files, and the command line."""

import json

import pytest

import tessera
from tessera.__main__ import main
from tessera.sources.files import from_csv, from_json, to_csv, to_json


def test_simple_json(spark, tmp_path):
    data = {"a": {"b": 1, "c": {"d": "text", "e": None}}, "flag": True, "real": 2.5, "few": [1, 2, 3], "many": list(range(150)), "mixed": [1, 2.5], "words": ["x", "y"], "bad": [1, "x"], "none": [], "grid": [[1, 2], [3], [4.5, 6, 7]], "texts": [["a"], ["b", "c"]]}
    (tmp_path / "a.json").write_text("a preamble\n" + json.dumps(data, indent=1))
    ds = from_json(spark, f"file://{tmp_path}/a.json", f"file://{tmp_path}/a.nda")
    ds = tessera.open_dataset(spark, ds.root)
    assert ds.keys() == ["many"] and ds["many"].to_numpy().tolist() == list(range(150)) and ds.dtype_of("many") == "int64"
    meta = {k: v for k, v in ds.meta.get_all().items()}
    assert set(meta) == {"a/b", "a/c/d", "flag", "real", "few", "mixed", "words", "none", "grid", "texts"}
    assert meta["a/b"].data == (1,) and meta["a/c/d"].data == ("text",) and meta["flag"].data == (1,) and meta["real"].data == (2.5,)
    assert meta["few"].dtype == "int64" and meta["mixed"].to_numpy().tolist() == [1.0, 2.5] and meta["words"].data == ("x", "y") and meta["none"].shape == (0,)
    assert meta["grid"].to_numpy().tolist() == [[1, 2, 0], [3, 0, 0], [4.5, 6, 7]] and meta["texts"].to_numpy().tolist() == [["a", ""], ["b", "c"]]


def test_structured_json(spark, tmp_path):
    arrays = {"x": {"dtype": "int16", "shape": [2, 2], "data": [1, 2, 3, 4]}, "s": {"dtype": "string", "shape": [1], "data": ["é"]}}
    (tmp_path / "a.json").write_text(json.dumps({"format": "any", "version": "1.0", "arrays": arrays}))
    ds = from_json(spark, f"file://{tmp_path}/a.json", f"file://{tmp_path}/a.nda")
    assert ds["x"].to_numpy().tolist() == [[1, 2], [3, 4]] and ds.dtype_of("x") == "int16" and ds["s"].to_numpy().tolist() == ["é"]
    assert {r.key: json.loads(r.json) for r in to_json(ds).collect()} == arrays


def test_csv_and_commands(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n5,6\n")
    ds = from_csv(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/a.nda")
    assert to_csv(ds, f"file://{tmp_path}/out") == "data"
    assert spark.read.text(f"file://{tmp_path}/out").count() == 3
    top = f"file://{tmp_path}"
    main(["convert", f"{top}/a.csv", f"{top}/b.nda", "-c", "none"], spark)
    main(["convert", f"{top}/b.nda", f"{top}/c.nda"], spark)
    main(["convert", f"{top}/c.nda", f"{top}/d.json"], spark)
    main(["show", f"{top}/c.nda"], spark)
    main(["show", f"{top}/c.nda", "data"], spark)
    out = capsys.readouterr().out
    assert "__base__/data: int64 [3, 2], 6 elements, 48 bytes" in out and "1, 2, 3, 4, 5, 6" in out
    with pytest.raises(ValueError):
        main(["convert", f"{top}/a.csv", f"{top}/b.json"], spark)

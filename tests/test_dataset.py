"""Stored datasets: round trips, metadata, layers, conversion, inspection, pushed filters."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera
from tessera.functions.indexing import byte_planes, from_byte_planes, with_row_index
from tessera.operators import codec, convert, inspect, metadata
from tessera.sources.paths import parse_path, require_writable
from tessera.streaming.cells import append_cells, block_statistics, latest_cells


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/d"


def test_round_trip(spark, path):
    big = np.arange(200_000, dtype=np.float32).reshape(400, 500)
    with tessera.create(spark, path, tessera.Config(codec="lz4")) as ds:
        ds["big"] = big
        for i in range(12):
            ds[f"small{i}"] = np.arange(i, dtype=np.int16)
        ds["words"] = np.array(["a", "b,c"])
        ds["scalar"] = tessera.from_numpy(spark, 3.5)
        ds.meta["name"] = "sensor"
        ds.meta["shape"] = [1, 2, 3]
        ds.meta["huge"] = np.uint64(2**64 - 1)
        with pytest.raises(TypeError):
            ds["x"] = 5
        assert not ds.is_sliceable("big")
    back = tessera.open_dataset(spark, path)
    assert back.keys() == ["big", *[f"small{i}" for i in range(12)], "words", "scalar"] and len(back) == 15 and "name" in back and "none" not in back
    assert (back["big"].to_numpy() == big).all() and back["small7"].to_numpy().tolist() == list(range(7)) and back["words"].to_numpy().tolist() == ["a", "b,c"]
    assert back["scalar"].shape == () and back.dtype_of("small3") == "int16" and back.is_sliceable("big")
    assert back.meta["name"] == "sensor" and back.meta["shape"].tolist() == [1, 2, 3] and back.meta["huge"] == 2**64 - 1
    assert (back.get_slice("big", [(10, 20), (0, 500, 7)]).to_numpy() == big[10:20, 0:500:7]).all()
    plan = back.get_slice("big", [(10, 20), (30, 40)]).cells._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(idx," in plan
    for wrong, kind in ((lambda: back.put("y", big), PermissionError), (lambda: back["nope"], KeyError), (lambda: back.get("big", "int8"), TypeError), (lambda: back.get_slice("name", []), ValueError), (lambda: back.get_slice("nope", []), KeyError)):
        with pytest.raises(kind):
            wrong()


def test_versions_and_modes(spark, path, tmp_path):
    with pytest.raises(FileNotFoundError):
        tessera.open_dataset(spark, path)
    with pytest.raises(ValueError):
        tessera.open_dataset(spark, path, "q")
    for k in range(3):
        with tessera.open_dataset(spark, path, "a") as ds:
            ds["x"] = np.full(k + 1, float(k)) if k < 2 else np.arange(4)
    old = tessera.open_dataset(spark, path)
    assert old["x"].dtype == "int64" and old.version == 3
    fresh = tessera.create(spark, path)
    fresh["y"] = np.zeros(2)
    assert old["x"].to_numpy().tolist() == [0, 1, 2, 3]
    fresh.close()
    assert tessera.open_dataset(spark, path).keys() == ["y"]
    (tmp_path / "bad" / "state").mkdir(parents=True)
    (tmp_path / "bad" / "state" / "x.parquet").write_bytes(b"junk")
    with pytest.raises(Exception):
        tessera.open_dataset(spark, f"file://{tmp_path}/bad")


def test_copies(spark, path, tmp_path):
    with tessera.create(spark, path) as ds:
        ds["x"], ds["long"] = np.arange(5, dtype=np.uint8), np.arange(500)
        ds.meta["m"], ds.meta["wide"] = 4, list(range(300))
        ds.create_layer("l")["x"] = np.arange(3)
    ds = tessera.open_dataset(spark, path)
    with pytest.raises(ValueError, match="can't be sliced"):
        ds.get_slice("x", [(0, 1)])
    with pytest.raises(ValueError):
        ds.save_to(path)
    copy = ds.save_to(path + "2", tessera.Config(codec="none"))
    assert copy.get_slice("x", [(1, 3)]).to_numpy().tolist() == [1, 2] and copy.get_layer("l")["x"].to_numpy().tolist() == [0, 1, 2]
    moved = tessera.open_dataset(spark, ds.reorganize(path + "3").root)
    assert moved.keys() == ["long", "wide"] and moved.meta["x"].tolist() == [0, 1, 2, 3, 4] and moved.meta["m"] == 4
    data = ds.write_bytes()
    again = tessera.open_bytes(spark, data)
    assert again["x"].to_numpy().tolist() == [0, 1, 2, 3, 4] and again.meta["wide"].tolist() == list(range(300)) and again.read_only and again.list_layers() == ["l"]
    for bad in (b"", b"garbage"):
        with pytest.raises(ValueError):
            tessera.open_bytes(spark, bad)
    with pytest.raises(MemoryError):
        ds.write_bytes(most=10)


def test_metadata(spark, path):
    ds = tessera.create(spark, path)
    ds.meta.put_batch({"c": 3.0, "a": 1, "b": "t", "e": ["x", "y"]})
    assert ds.meta.keys() == ["a", "b", "c", "e"] and list(ds.meta.get_batch(["c", "a", "z"])) == ["a", "c"] and ds.meta.get("z") is None
    assert ds.meta.value("a").is_scalar and ds.meta.value("e").is_array and ds.meta.value("a").try_as("float64") is None
    with pytest.raises(TypeError):
        ds.meta.value("a").as_type("float64")
    with pytest.raises(KeyError):
        ds.meta["z"]
    ds.meta.remove("a")
    ds.create_layer("l").meta["c"] = 9
    assert ds.metadata_keys() == ["b", "c", "e"] and ds.metadata_count() == 4
    assert {(r.layer, r.key): r["size"] for r in metadata.described(ds.metadata_table()).collect()} == {("__base__", "b"): 1, ("__base__", "c"): 1, ("__base__", "e"): 2, ("l", "c"): 1}
    ds.meta.clear()
    assert len(ds.meta) == 0 and ds.get_layer("l").meta["c"] == 9


def test_layers(spark, path):
    ds = tessera.create(spark, path)
    ds["a"], ds.meta["m"], ds.meta["n"] = np.zeros(2), 1, 2
    names = ["", "x" * 1000, "band-0", "band_0", "band.0", "band:0"]
    views = [ds.create_layer(n) for n in names]
    for bad in ("band-0", "__base__"):
        with pytest.raises(ValueError):
            ds.create_layer(bad)
    one, two = views[2:4]
    one["a"], one["b"], one.meta["m"] = np.ones(3), np.ones(1), 5
    assert one.keys() == ["a", "b", "m"] and two.keys() == [] and "a" not in two and one.meta["m"] == 5
    with pytest.raises(KeyError):
        two["a"]
    ds.layer_inheritance = True
    assert two["a"].to_numpy().tolist() == [0, 0] and one["a"].to_numpy().tolist() == [1, 1, 1] and "a" in two and one.keys() == ["a", "b", "m", "n"]
    assert ds.key_in_layer("a", "__base__") and not ds.key_in_layer("a", "band_0") and ds.key_in_layer("b", "band-0")
    one.meta.remove("m")
    assert one.meta["m"] == 1
    ds.flush()
    back = tessera.open_dataset(spark, path)
    assert back.list_layers() == names and back.has_layer("__base__") and not back.has_layer("zz") and back.get_layer("band-0").keys() == ["a", "b"]
    with pytest.raises(KeyError):
        back.get_layer("zz")


def test_codecs(spark):
    data = np.arange(999, dtype=np.int32).tobytes()
    assert codec.unshuffled(codec.shuffled(data, 4), 4) == data and codec.base_codec("gzip_shuffle") == "gzip" and codec.uses_shuffle("lz4_shuffle")
    for bad in ("zstd", "what"):
        with pytest.raises(ValueError):
            codec.parquet_codec(bad)
    cells = tessera.arange(spark, 5000).cells
    plain, packed = (codec.block_sizes(cells, "int64", c, 8192).orderBy("block_id").collect() for c in ("none", "gzip_shuffle"))
    assert [r.uncompressed for r in plain] == [8192] * 4 + [5000 * 8 - 4 * 8192] and all(a.compressed > b.compressed for a, b in zip(plain, packed, strict=True))
    back = from_byte_planes(byte_planes(cells.withColumn("value", F.col("value") * 97 - 1000), 8))
    assert back.where("value <> idx * 97 - 1000").count() == 0 and back.count() == 5000


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,2.5,3\n\n4,"5",\n6\n7,8,9,10\n')
    a = convert.csv_to_array(spark.read.text(f"file://{tmp_path}/a.csv"))
    assert a.dtype == "float64" and a.to_numpy().tolist() == [[1, 2.5, 3], [4, 5, 0], [6, 0, 0], [7, 8, 9]]
    (tmp_path / "b.csv").write_text('x,"a,b",2\n"q ""r""",,3\n')
    b = convert.csv_to_array(spark.read.text(f"file://{tmp_path}/b.csv"))
    assert b.to_numpy().tolist() == [["x", "a,b", "2"], ['q "r"', "", "3"]]
    lines = [r.line for r in convert.array_to_csv(b).orderBy("row").collect()]
    assert lines == ['x,"a,b",2', '"q ""r""",,3']
    (tmp_path / "c.csv").write_text("1,+2\n3,-4\n")
    assert convert.csv_to_array(spark.read.text(f"file://{tmp_path}/c.csv")).to_numpy().tolist() == [[1, 2], [3, -4]]
    with pytest.raises(ValueError):
        convert.array_to_csv(tessera.zeros(spark, 3))
    rows = with_row_index(spark.range(1000, numPartitions=7).select("id"))
    assert rows.where("idx <> id").count() == 0


def test_json(spark):
    text = 'note: {"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2], "f": null, "g": true, "h": 2.5}'
    rows = {r.key: r.kind for r in convert.flatten_json(spark.createDataFrame([(1, text)], "id long, text string")).select("key", "kind").collect()}
    assert set(rows) == {"a/b", "a/c/d", "e", "g", "h"} and rows["a/b"] == "BIGINT" and rows["e"] == "ARRAY<BIGINT>"
    data = json.loads(convert.envelope(tessera.arange(spark, 6).reshape((2, 3))).first()["json"])
    assert data == {"dtype": "int64", "shape": [2, 3], "data": [0, 1, 2, 3, 4, 5]}
    kinds = lambda *k: spark.createDataFrame([(x,) for x in k], "kind string").agg(convert.element_dtype(F.col("kind")).alias("t")).first()["t"]
    assert [kinds("BIGINT"), kinds("BIGINT", "DECIMAL(2,1)"), kinds("BIGINT", "STRING"), kinds()] == ["int64", "float64", "string", "float64"]
    ragged = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4]), ("c", [])], "key string, items array<int>")
    assert {(r.key, r.pos): r.value for r in convert.padded_grid(ragged, 0).collect()} == {("a", 0): 1, ("a", 1): 2, ("a", 2): 3, ("b", 0): 4, ("b", 1): 0, ("b", 2): 0, ("c", 0): 0, ("c", 1): 0, ("c", 2): 0}
    assert convert.detect_format("/x/Y.JSON") == "json" and convert.detect_format("a.mp") == "msgpack"
    with pytest.raises(ValueError):
        convert.detect_format("noext")


def test_inspection(spark, path):
    ds = tessera.create(spark, path, tessera.Config(codec="none"))
    ds["v"], ds["s"] = np.arange(250.0), tessera.from_numpy(spark, 1)
    text = ds.show("v")
    assert text.startswith("0.000, 1.000") and text.endswith("... (150 more)") and len(text.split("\n")) == 11
    with pytest.raises(KeyError, match="there are v, s"):
        ds.show("z")
    assert tuple(inspect.summary(ds.catalog()).first()) == (2, 251, 251 * 8)
    v = lambda *x: spark.createDataFrame([(list(x),)], "v array<string>").select(inspect.preview(F.col("v"), True)).first()[0]
    assert v("a" * 50) == "a" * 37 + "..." and v("b" * 30, "c") == "[" + "b" * 17 + "..., c]" and v(*"abcd") == "[4 elements]"


def test_paths(monkeypatch):
    monkeypatch.delenv("AWS_REGION", raising=False)
    assert parse_path("/vsis3/b/k/x").uri == "s3a://b/k/x" and parse_path("s3://b/k").region == "us-east-1"
    assert parse_path("/vsicurl/http://h/x").kind == "http" and parse_path("/tmp/x").kind == "local" and parse_path("hdfs://n/x").kind == "hadoop"
    for bad in ("s3://b", "s3://b/", "/vsicurl/what"):
        with pytest.raises(ValueError):
            parse_path(bad)
    with pytest.raises(ValueError):
        require_writable("https://h/x")


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(100).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("at")).write.parquet(source)
    stream = spark.readStream.schema("idx long, value long, at timestamp").parquet(source)
    append_cells(stream, f"{tmp_path}/out", "int64", f"{tmp_path}/check").awaitTermination()
    append_cells(stream, f"{tmp_path}/out", "int64", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    q = block_statistics(stream, 10, "at").writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("blocks").agg(F.sum("n")).first()[0] == 100
    twice = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "idx long, value long, seq int")
    assert {(r.idx, r.value) for r in latest_cells(twice, "seq").collect()} == {(1, 6), (2, 7)}


@pytest.mark.parametrize("name", ["int8", "uint16", "int32", "uint64", "float32", "float64"])
def test_shuffled_arrays_are_stored_as_planes(spark, tmp_path, name):
    """Blocks of byte planes, smaller than plain cells for slowly growing numbers, and the same values back."""
    values = (np.arange(70_000) // 3 % 120).astype(name)
    for name_ in ("lz4", "lz4_shuffle"):
        with tessera.create(spark, f"file://{tmp_path}/{name_}", tessera.Config(codec=name_, block_bytes=4096)) as ds:
            ds["x"], ds["y"] = values, values[:5000].reshape(50, 100)
        ds = tessera.open_dataset(spark, f"file://{tmp_path}/{name_}")
        assert (ds["x"].to_numpy() == values).all() and (ds["y"].to_numpy() == values[:5000].reshape(50, 100)).all()
        path = ds._entries["__base__", "x"].path
        kept = spark.read.parquet(f"file://{tmp_path}/{name_}/{path}")
        if name_ == "lz4_shuffle":
            per_block = 4096 // values.itemsize
            assert kept.columns == ["array_id", "block", "n", "planes"] and kept.count() == -(-70_000 // per_block)
            first = bytes(kept.where("block = 1").first().planes)
            assert first == values[per_block : 2 * per_block].view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    tessera.create(spark, f"file://{tmp_path}/d").flush()
    one, two = (tessera.open_dataset(spark, f"file://{tmp_path}/d", "w") for _ in range(2))
    one.meta["a"], two.meta["b"] = 1, 2
    one.flush()
    with pytest.raises(RuntimeError, match="another writer"):
        two.flush()
    assert tessera.open_dataset(spark, f"file://{tmp_path}/d").meta.keys() == ["a"]

"""Queries that apply the array operators to whole tables, and the same in SQL."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from math import prod
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.indexing import byte_planes, from_byte_planes
from tessera.operators import codec, convert, inspect, layers, metadata
from tessera.operators.array import ArrayFrame, arange, from_numpy, from_table, from_vectors, full, ones, zeros
from tessera.operators.slicing import block_ranges, blocks_of, merged_runs, normalize, predicate
from tessera.sources.dataset import Config, Dataset, create, open_dataset
from tessera.sources.paths import host_of, store_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str = ""):
    def registered(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return registered


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def totals(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    orders = load(spark, sf_dir, "orders")
    return from_table(orders, "o_orderkey", "o_totalprice", orders.count())


def vectors(spark: SparkSession, sf_dir: str, *shape: int) -> ArrayFrame:
    table = load(spark, sf_dir, "embeddings")
    n = table.count()
    array = from_vectors(table, "vec_id", "embedding", n, 64)
    return array.reshape((n, *shape)) if shape else array


# slices

_ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS idx, o_totalprice AS value FROM orders"
_VECTORS = "SELECT CAST(vec_id AS BIGINT) * 64 + p AS idx, CAST(vec_id AS BIGINT) AS i0, p AS i1, embedding[p + 1] AS value FROM embeddings, range(64) r(p)"
_CUBE = "SELECT CAST(vec_id AS BIGINT) * 64 + p AS idx, CAST(vec_id AS BIGINT) AS i0, p // 8 AS i1, p % 8 AS i2, embedding[p + 1] AS value FROM embeddings, range(64) r(p)"


def _slice_1d(name: str, start: int, stop: int, step: int = 1) -> None:
    sql = f"SELECT (idx - {start}) // {step} AS idx, value FROM ({_ORDERS}) WHERE idx >= {start} AND idx < {stop} AND (idx - {start}) % {step} = 0"
    query(sql, name)(lambda spark, d: totals(spark, d).slice([(start, stop, step)]).cells)


_slice_1d("slice_1d_head", 0, 100)
_slice_1d("slice_1d_mid", 1000, 1100)
_slice_1d("slice_1d_one", 50, 51)
_slice_1d("slice_1d_step", 100, 1400, 7)
_slice_1d("slice_1d_step_from0_multiblock", 0, 1500, 2)


@query(f"WITH c AS ({_ORDERS}), n AS (SELECT count(*) AS n FROM orders) SELECT idx - (n - 100) AS idx, value FROM c, n WHERE idx >= n - 100")
def slice_1d_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = totals(spark, sf_dir)
    return array.slice([(array.size - 100, array.size)]).cells


def _slice_nd(name: str, source: str, shape: tuple[int, ...], *slices: tuple[int, ...]) -> None:
    """Slices of the embeddings as rows x shape; a dimension without a slice is whole."""
    tests, out = [], "0"
    spec = [*slices, *[(0, n) for n in shape[len(slices) - 1 :]]] if slices else []
    lengths = [-(-(s[1] - s[0]) // (s[2] if len(s) > 2 else 1)) for s in spec]
    for k, s in enumerate(spec):
        step = s[2] if len(s) > 2 else 1
        tests.append(f"i{k} >= {s[0]} AND i{k} < {s[1]} AND (i{k} - {s[0]}) % {step} = 0")
        out += f" + ((i{k} - {s[0]}) // {step}) * {prod(lengths[k + 1 :])}"
    sql = f"SELECT CAST({out} AS BIGINT) AS idx, value FROM ({source}) WHERE {' AND '.join(tests)}"
    query(sql, name)(lambda spark, d: vectors(spark, d, *(shape if len(shape) > 1 else ())).slice(slices).cells)


_slice_nd("slice_2d_rows", _VECTORS, (64,), (10, 20), (0, 64))
_slice_nd("slice_2d_sub", _VECTORS, (64,), (10, 20), (30, 40))
_slice_nd("slice_2d_cols", _VECTORS, (64,), (0, 200), (5, 9))
_slice_nd("slice_2d_missing_trailing", _VECTORS, (64,), (3, 6))
_slice_nd("slice_2d_step_both", _VECTORS, (64,), (0, 100, 3), (1, 60, 7))
_slice_nd("slice_3d_hyperslab", _CUBE, (8, 8), (5, 10), (3, 8), (0, 8))
_slice_nd("slice_3d_step", _CUBE, (8, 8), (10, 60, 3), (2, 6), (1, 8, 2))


@query(f"SELECT idx, value FROM ({_CUBE})")
def slice_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, 8, 8).slice([]).cells


def stored(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


@query(f"SELECT (idx - 200) // 3 AS idx, value FROM ({_ORDERS}) WHERE idx >= 200 AND idx < 1200 AND (idx - 200) % 3 = 0")
def stored_slice_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put into a dataset, flushed, opened again and sliced there, with the index range pushed to the scan."""
    path = stored(spark, "slice")
    with create(spark, path, Config(codec="lz4")) as ds:
        ds.put("totals", totals(spark, sf_dir))
    return open_dataset(spark, path).get_slice("totals", [(200, 1200, 3)]).cells


def _stored_vectors(spark: SparkSession, sf_dir: str, codec: str, *shape: int) -> Dataset:
    path = stored(spark, "vectors")
    with create(spark, path, Config(codec=codec, block_bytes=8192)) as ds:
        ds.put("vectors", vectors(spark, sf_dir, *shape))
    return open_dataset(spark, path)


@query("SELECT CAST((i0 - 30) // 4 * 16 + i1 - 8 AS BIGINT) AS idx, value FROM (" + _VECTORS + ") WHERE i0 >= 30 AND i0 < 60 AND i1 >= 8 AND i1 < 24 AND (i0 - 30) % 4 = 0")
def stored_slice_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_vectors(spark, sf_dir, "lz4").get_slice("vectors", [(30, 60, 4), (8, 24)]).cells


@query("SELECT CAST((i0 - 10) * 10 + (i1 - 2) * 2 + (i2 - 3) // 3 AS BIGINT) AS idx, value FROM (" + _CUBE + ") WHERE i0 >= 10 AND i0 < 40 AND i1 >= 2 AND i1 < 7 AND i2 >= 3 AND (i2 - 3) % 3 = 0")
def stored_slice_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_vectors(spark, sf_dir, "gzip", 8, 8).get_slice("vectors", [(10, 40), (2, 7), (3, 8, 3)]).cells


def _stored_codec(codec: str) -> None:
    """All vectors, stored under a codec and read back."""
    query(f"SELECT idx, value FROM ({_VECTORS})", f"stored_{codec}")(lambda spark, d: _stored_vectors(spark, d, codec)["vectors"].cells)


for _codec in codec.PARQUET:
    _stored_codec(_codec)


# single cells, scans, shapes, factories


@query(f"SELECT idx, value FROM ({_VECTORS}) WHERE i0 = 17 AND i1 = 23")
def point_read_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).at(17, 23)


@query(f"SELECT idx, value FROM ({_VECTORS}) WHERE idx = 4711")
def flat_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).flat(4711)


@query(f"SELECT (SELECT count(*) FROM orders) - 1 - idx AS idx, value FROM ({_ORDERS})")
def reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = totals(spark, sf_dir)
    return array.cells.select((F.lit(array.size - 1).cast("bigint") - F.col("idx")).alias("idx"), "value")


@query(f"SELECT idx, i0, i1, i2, value FROM ({_CUBE})")
def reshape_2d_to_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = vectors(spark, sf_dir)
    return array.reshape((array.shape[0], 8, 8)).coordinates()


@query(f"SELECT idx, i0, i1, value FROM ({_VECTORS})")
def strides_unravel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).coordinates()


@query(f"SELECT idx, value FROM ({_ORDERS}) UNION ALL SELECT n + i, CAST(-1 AS DOUBLE) FROM (SELECT count(*) AS n FROM orders), range(500) r(i)")
def resize_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = totals(spark, sf_dir)
    return array.resize(array.size + 500, -1.0).cells


@query(f"SELECT idx, value FROM ({_ORDERS}) WHERE idx < 700")
def resize_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).resize((7, 100)).cells


@query(f"SELECT idx, value * 2 + 1 AS value FROM ({_ORDERS})")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).map(lambda v: v * 2 + 1).cells


@query("SELECT i AS idx, i * 3 AS value FROM range(334) r(i)")
def arange_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arange(spark, 0, 1000, 3).cells


@query("SELECT i AS idx, CAST(10 - 2 * i AS BIGINT) AS value FROM range(10) r(i)")
def arange_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arange(spark, 10, -10, -2).cells


@query("SELECT i AS idx, CAST(0 AS DOUBLE) AS value FROM range(600) r(i)", "zeros")
def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zeros(spark, (20, 30)).cells


@query("SELECT i AS idx, CAST(1 AS INTEGER) AS value FROM range(600) r(i)", "ones")
def _ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ones(spark, (20, 30), "int32").cells


@query("SELECT i AS idx, CAST(2.5 AS FLOAT) AS value FROM range(600) r(i)", "full")
def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, 600, 2.5, "float32").cells


# blocks and bytes


@query(f"SELECT idx // 512 AS block_id, count(*) AS n, min(idx) AS first, max(idx) AS last FROM ({_VECTORS}) GROUP BY 1")
def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.block_map(vectors(spark, sf_dir).cells, 512)


@query(f"SELECT DISTINCT idx // 128 AS block_id FROM ({_ORDERS}) WHERE idx >= 300 AND idx < 900")
def block_prune_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, block_ranges(totals(spark, sf_dir).shape, [(300, 900)], 128))


@query(f"SELECT DISTINCT idx // 512 AS block_id FROM ({_VECTORS}) WHERE i0 >= 30 AND i0 < 60 AND i1 >= 8 AND i1 < 24 AND i0 % 4 = 2")
def block_prune_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that a strided slice's cells lie in, through the slice's own predicate."""
    array = vectors(spark, sf_dir)
    slices = normalize(array.shape, [(30, 60, 4), (8, 24)])
    return codec.with_block(array.cells.where(predicate(F.col("idx"), array.shape, slices)), 512).select("block_id").distinct()


@query(f"""
WITH b AS (SELECT DISTINCT idx // 64 AS b FROM ({_VECTORS}) WHERE i0 >= 4 AND i0 < 40 AND i0 % 9 >= 4 AND i0 % 9 < 6),
  g AS (SELECT b, b - row_number() OVER (ORDER BY b) AS g FROM b)
SELECT min(b) AS first, max(b) AS last FROM g GROUP BY g""")
def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = vectors(spark, sf_dir).shape
    runs = [run for k in range(4, 40, 9) for run in block_ranges(shape, [(k, k + 2)], 64)]
    return spark.createDataFrame(merged_runs(runs), "first bigint, last bigint")


@query("SELECT CAST(p AS BIGINT) AS plane, CAST(o_orderkey AS BIGINT) AS idx, (CAST(o_custkey AS BIGINT) >> CAST(8 * p AS BIGINT)) & 255 AS byte FROM orders, range(8) r(p)")
def byte_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_planes(load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("idx"), F.col("o_custkey").cast("bigint").alias("value")), 8)


@query("SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(o_custkey AS BIGINT) AS value FROM orders")
def byte_unshuffle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_byte_planes(byte_plane(spark, sf_dir))


@query(f"SELECT idx // 1000 AS block_id, CAST(count(*) * 8 AS BIGINT) AS uncompressed, CAST(count(*) * 8 AS BIGINT) AS compressed FROM ({_ORDERS}) GROUP BY 1")
def block_sizes_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.block_sizes(totals(spark, sf_dir).cells, "float64", "none", 8000)


@query()
def block_sizes_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under each codec, as zlib and LZ4 give them; SQL has neither."""
    return codec.codec_parity(totals(spark, sf_dir).cells, "float64", codec.PARQUET)


# catalog and inspection

_CATALOG = """
WITH sized(layer, key, dtype, n, elem_size, codec, block_bytes, sliceable, ord) AS (
  SELECT '__base__', 'totals', 'float64', count(*), 8, 'lz4', 4096, true, 0 FROM orders UNION ALL
  SELECT '__base__', 'vectors', 'float32', count(*) * 64, 4, 'lz4_shuffle', 1048576, false, 1 FROM embeddings UNION ALL
  SELECT '__base__', 'cube', 'float32', count(*) * 64, 4, 'lz4', 4096, true, 2 FROM embeddings UNION ALL
  SELECT '__base__', 'scalar', 'float64', 1, 8, 'none', 4096, true, 3)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of a dataset with arrays from the driver's tables, stored and opened again."""
    path, all_vectors = stored(spark, "catalog"), vectors(spark, sf_dir)
    with create(spark, path) as ds:
        for key, array, config in (
            ("totals", totals(spark, sf_dir), Config("lz4", 4096)),
            ("vectors", all_vectors, Config("lz4_shuffle", 1 << 20)),
            ("cube", all_vectors.reshape((all_vectors.shape[0], 8, 8)), Config("lz4", 4096)),
            ("scalar", from_numpy(spark, 2.5), Config("none", 4096)),
        ):
            ds.config = config
            ds.put(key, array)
    return open_dataset(spark, path).catalog()


@query(_CATALOG + "SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_elements, CAST(sum(n * elem_size) AS BIGINT) AS n_bytes FROM sized")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.summary(catalog(spark, sf_dir))


@query(_CATALOG + "SELECT codec, count(*) AS n FROM sized GROUP BY codec")
def codec_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.codec_histogram(catalog(spark, sf_dir))


@query(_CATALOG + "SELECT CAST(least(n * elem_size, block_bytes) AS BIGINT) AS first_block_bytes, count(*) AS n FROM sized GROUP BY 1")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.block_histogram(catalog(spark, sf_dir))


@query(_CATALOG + "SELECT key, dtype, n AS n_elements, CAST(n * elem_size AS BIGINT) AS n_bytes, CAST((n * elem_size + block_bytes - 1) // block_bytes AS BIGINT) AS n_blocks FROM sized")
def catalog_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.listing(catalog(spark, sf_dir)).select("key", "dtype", "n_elements", "n_bytes", "n_blocks")


@query(_CATALOG + "SELECT key, sliceable FROM sized")
def sliceable_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("key", "sliceable")


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS preview FROM documents")
def preview_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", inspect.shortened(F.col("text")).alias("preview"))


@query(f"SELECT idx, value FROM ({_ORDERS}) ORDER BY idx LIMIT 100")
def preview_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.head(totals(spark, sf_dir).cells)


# metadata


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata table of a dataset with a layer, stored and opened again; its values are those of two small tables."""
    path = stored(spark, "metadata")
    with create(spark, path) as ds:
        ds.create_layer("regions")
        for r in load(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("k")).collect():
            ds.meta.put(r.n_name, r.k)
            if r.k < 5:
                ds.get_layer("regions").meta.put(r.n_name, r.k + 1000)
        for r in load(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").cast("bigint").alias("k")).collect():
            ds.get_layer("regions").meta.put(r.r_name, r.k + 100)
    return open_dataset(spark, path).metadata_table().select("layer", "key", F.col("v.i")[0].alias("value"))


_META = """
WITH meta(layer, key, value) AS (
  SELECT '__base__', n_name, CAST(n_nationkey AS BIGINT) FROM nation UNION ALL
  SELECT 'regions', r_name, CAST(r_regionkey + 100 AS BIGINT) FROM region UNION ALL
  SELECT 'regions', n_name, CAST(n_nationkey + 1000 AS BIGINT) FROM nation WHERE n_nationkey < 5)
"""


@query(_META + "SELECT * FROM meta WHERE layer = '__base__' AND key IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def meta_get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("key")).unionByName(spark.createDataFrame([("missing",)], "key string"))
    return metadata.get_batch(nations(spark, sf_dir), wanted).select("layer", "key", "value")


@query(_META + "SELECT * FROM meta WHERE layer = '__base__'")
def meta_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.get_all(nations(spark, sf_dir))


@query(_META + "SELECT * FROM meta WHERE NOT (layer = '__base__' AND key IN (SELECT n_name FROM nation WHERE n_regionkey = 2))")
def meta_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.remove(nations(spark, sf_dir), load(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("key"))).select("layer", "key", "value")


@query(_META + "SELECT layer, key, CASE WHEN layer = '__base__' AND value % 3 = 0 THEN value * 10 ELSE value END AS value FROM meta")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = nations(spark, sf_dir)
    new = meta.where("layer = '__base__' and value % 3 = 0").select("layer", "key", (F.col("value") * 10).alias("value"))
    return metadata.upsert(meta, new).select("layer", "key", "value")


@query(_META + "SELECT * FROM meta WHERE layer <> 'regions'")
def meta_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.clear(nations(spark, sf_dir), "regions")


@query(_META + "SELECT DISTINCT key FROM meta")
def meta_keys_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.all_keys(nations(spark, sf_dir))


@query(_META + "SELECT count(*) AS n FROM meta")
def meta_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count(nations(spark, sf_dir))


@query("""
SELECT * FROM (VALUES ('__base__', 'name', 'string', 0, CAST(1 AS BIGINT), true), ('__base__', 'rate', 'float64', 0, 1, true),
  ('__base__', 'size', 'int64', 1, 1, true), ('__base__', 'sizes', 'int64', 2, 6, false)) t(layer, key, dtype, ndim, size, is_scalar)""")
def meta_type_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.of_mapping({"name": "x", "rate": 0.5, "size": [3], "sizes": [[1, 2, 3], [4, 5, 6]]})
    return metadata.described(spark.createDataFrame(rows, metadata.SCHEMA))


# layers

_LAYERED = """
WITH kv(layer, key, value) AS (
  SELECT '__base__', doc_id, source FROM documents UNION ALL
  SELECT 'labels', doc_id, 'q' || quality FROM labels UNION ALL
  SELECT 'english', doc_id, 'en' FROM documents WHERE lang = 'en')
"""


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    base = docs.select(F.lit("__base__").alias("layer"), F.col("doc_id").alias("key"), F.col("source").alias("value"))
    return base.unionByName(labels.select(F.lit("labels").alias("layer"), F.col("doc_id").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))).unionByName(docs.where("lang = 'en'").select(F.lit("english").alias("layer"), F.col("doc_id").alias("key"), F.lit("en").alias("value")))


@query(_LAYERED + "SELECT key, value FROM kv WHERE layer = 'labels' UNION ALL SELECT key, value FROM kv WHERE layer = '__base__' AND key NOT IN (SELECT key FROM kv WHERE layer = 'labels')")
def layer_get_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.visible(layered(spark, sf_dir), "labels", True).select("key", "value")


@query(_LAYERED + "SELECT key, value FROM kv WHERE layer = 'labels'")
def layer_get_noinherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.visible(layered(spark, sf_dir), "labels", False).select("key", "value")


@query(_LAYERED + "SELECT DISTINCT key FROM kv WHERE layer IN ('labels', '__base__')")
def layer_keys_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_keys(layered(spark, sf_dir), "labels", True)


@query(_LAYERED + "SELECT DISTINCT key FROM kv WHERE layer = 'english'")
def layer_keys_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_keys(layered(spark, sf_dir), "english", False)


_WANTED = "SELECT CAST(i AS BIGINT) AS key FROM range(0, 3000, 7) r(i)"


@query(_LAYERED + f"SELECT key, key IN (SELECT key FROM kv WHERE layer IN ('english', '__base__')) AS contained FROM ({_WANTED})")
def layer_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.contains(layered(spark, sf_dir), spark.range(0, 3000, 7).toDF("key"), "english", True)


@query(_LAYERED + f"SELECT key, key IN (SELECT key FROM kv WHERE layer = 'english') AS contained FROM ({_WANTED})")
def key_in_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.key_in_layer(layered(spark, sf_dir), spark.range(0, 3000, 7).toDF("key"), "english")


@query("""
SELECT d.doc_id AS key, CASE WHEN lang = 'en' THEN 'en' WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE source END AS value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def layer_override_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = layered(spark, sf_dir)
    return layers.overlay(layers.own(kv, "__base__"), layers.own(kv, "labels"), layers.own(kv, "english"))


@query("SELECT CAST(0 AS BIGINT) AS idx, CAST(10 AS BIGINT) AS value, 'label x' AS label UNION ALL SELECT 1, 20, 'label x'")
def namespace_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key in both namespaces, stored and read back from each."""
    path = stored(spark, "namespaces")
    with create(spark, path) as ds:
        ds["x"] = arange(spark, 10, 30, 10)
        ds.meta["x"] = "label x"
    ds = open_dataset(spark, path)
    return ds["x"].cells.withColumn("label", F.lit(ds.meta["x"]))


# conversion


@query("SELECT CAST(event_id AS BIGINT) AS id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def json_flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("id"), F.col("props").alias("text"))
    return convert.flatten_json(docs).select("id", "key", F.variant_get("value", "$", "bigint").alias("value"))


@query("SELECT 'k' AS key, CASE WHEN max(CAST(json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS INT)) = 1 THEN 'string' WHEN max(CAST(json_type(props, '$.k') = 'DOUBLE' AS INT)) = 1 THEN 'float64' ELSE 'int64' END AS dtype FROM events")
def json_infer_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("id"), F.col("props").alias("text"))
    return convert.flatten_json(docs).groupBy("key").agg(convert.element_dtype(F.col("kind")).alias("dtype"))


@query("""
WITH w AS (SELECT max(turn) + 1 AS w FROM conversations), grid AS (SELECT DISTINCT conv_id, CAST(p AS BIGINT) AS pos FROM conversations, w, range(w.w) r(p))
SELECT g.conv_id AS key, g.pos, coalesce(c.text, '') AS value FROM grid g LEFT JOIN conversations c ON g.conv_id = c.conv_id AND g.pos = c.turn""")
def json_ragged_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("items"))
    return convert.padded_grid(turns, "")


@query("SELECT '{\"dtype\":\"int64\",\"shape\":[5],\"data\":[0,3,6,9,12]}' AS json")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.envelope(arange(spark, 0, 15, 3))


@query("""
SELECT CAST(0 AS BIGINT) AS block, '{"dtype":"int64","shape":[' || count(*) || '],"blocks":' || CAST(ceil(count(*) / 1000.0) AS BIGINT) || '}' AS json FROM orders
UNION ALL SELECT CAST(o_orderkey AS BIGINT) // 1000 + 1, '{"data":[' || string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']}' FROM orders GROUP BY 1""")
def json_envelope_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"))
    return convert.envelope_blocks(from_table(orders, "o_orderkey", "o_custkey", orders.count()), 1000)


_LINES = "SELECT p_partkey, p_size, concat_ws(',', CAST(p_size AS VARCHAR), '\"' || replace(p_name, '\"', '\"\"') || '\"', '') AS line FROM part"


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.regexp_replace("p_name", '"', '""'), F.lit('"'))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", F.col("p_size").cast("string"), quoted, F.lit("")).alias("line"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, p_name AS b, '' AS c, 3 AS n FROM part")
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = convert.split_csv(F.col("line"))
    return part_lines(spark, sf_dir).select("p_partkey", f[0].alias("a"), f[1].alias("b"), f[2].alias("c"), F.size(f).alias("n"))


@query("SELECT 'int64' AS p_size, 'float64' AS p_retailprice, 'string' AS p_name, 'int64' AS blank")
def csv_infer_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_retailprice").cast("string"))
    return part.agg(convert.infer_dtype(F.col("p_size").cast("string")).alias("p_size"), convert.infer_dtype(price).alias("p_retailprice"), convert.infer_dtype(F.col("p_name")).alias("p_name"), convert.infer_dtype(F.lit(" ")).alias("blank"))


@query("SELECT i AS row, concat_ws(',', CAST(i * 4 AS VARCHAR), CAST(i * 4 + 1 AS VARCHAR), CAST(i * 4 + 2 AS VARCHAR), CAST(i * 4 + 3 AS VARCHAR)) AS line FROM range(250) r(i)")
def csv_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.array_to_csv(arange(spark, 1000).reshape((250, 4)))


@query("SELECT CAST(o_orderkey AS BIGINT) // 4 AS row, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_orderkey) AS line FROM orders GROUP BY 1")
def csv_export_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"))
    n = orders.count()
    return convert.array_to_csv(from_table(orders, "o_orderkey", "o_custkey", n).reshape((n // 4, 4)))


@query("SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'array' ELSE 'metadata' END AS place FROM documents")
def route_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", convert.route(F.col("n_chars"), 1000).alias("place"))


@query(f"SELECT idx, value FROM ({_ORDERS})")
def reencode_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored in one codec, saved in another, read back."""
    path = stored(spark, "reencode")
    with create(spark, path, Config(codec="gzip")) as ds:
        ds["totals"] = totals(spark, sf_dir)
    open_dataset(spark, path).save_to(path + "-2", Config(codec="lz4_shuffle"))
    return open_dataset(spark, path + "-2")["totals"].cells


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) AS extension FROM pages")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", convert.extension(F.col("url")).alias("extension"))


@query("SELECT page_id, 'http' AS store, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def parse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", store_of(F.col("url")).alias("store"), host_of(F.col("url")).alias("host"))

"""JSON and CSV files into datasets and out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import dtype
from tessera.operators import convert
from tessera.operators.array import ArrayFrame
from tessera.operators.metadata import MetaValue
from tessera.sources.dataset import Config, Dataset, create

FILL = {"int64": 0, "float64": 0.0, "string": ""}


def _elements(arrays: DataFrame) -> DataFrame:
    """arrays(key, value) as (key, pos, value, kind), one row per element."""
    return arrays.sparkSession.sql("select a.key, cast(e.pos as bigint) as pos, e.value, schema_of_variant(e.value) as kind from {arrays} a, lateral variant_explode(a.value) e", arrays=arrays)


def _store(ds: Dataset, key: str, array: ArrayFrame, threshold: int) -> None:
    if array.size > threshold:
        ds.put(key, array)
    else:
        ds.meta.put(key, MetaValue.of(array.to_numpy()))


def _grid(cells: DataFrame, rows: int, width: int, name: str) -> ArrayFrame:
    """cells(row, pos, value) of ragged rows, filled up to the widest."""
    spark, n = cells.sparkSession, rows * width
    at = cells.select((F.col("row") * F.lit(width).cast("bigint") + F.col("pos")).alias("idx"), "value")
    whole = spark.range(n).select(F.col("id").alias("idx")).join(at, "idx", "left")
    fill = F.lit(FILL[name]).cast(dtype(name).spark)
    return ArrayFrame(whole.select("idx", F.coalesce("value", fill).alias("value")), (rows, width), name)


def _put_simple(ds: Dataset, text: DataFrame, threshold: int) -> None:
    """Nested keys are joined by '/'; scalars, arrays and ragged arrays of arrays are typed by all their values.

    Keys whose values don't fit the inferred type are left out, as are nulls; booleans become 0 and 1.
    """
    leaves = convert.flatten_json(text)
    for row in leaves.where("kind not like 'ARRAY%'").select("key", "kind", F.col("value").cast("string").alias("text")).collect():
        if row.kind == "BOOLEAN":
            ds.meta.put(row.key, MetaValue("int64", (1,), (int(row.text == "true"),)))
        elif row.kind == "BIGINT":
            ds.meta.put(row.key, MetaValue("int64", (1,), (int(row.text),)))
        elif row.kind == "STRING":
            ds.meta.put(row.key, MetaValue("string", (1,), (row.text,)))
        else:
            ds.meta.put(row.key, MetaValue("float64", (1,), (float(row.text),)))
    arrays = leaves.where("kind like 'ARRAY%'").select("key", "value")
    first = _elements(arrays)
    nested = F.coalesce(F.max(F.col("kind").like("ARRAY%").cast("int")), F.lit(0)) == 1
    info = arrays.join(first.groupBy("key").agg(nested.alias("nested"), F.count("*").alias("n"), convert.element_dtype(F.col("kind")).alias("dtype")), "key", "left").select("key", "nested", "n", "dtype").collect()
    second = None
    for row in info:
        if not row.n:
            ds.meta.put(row.key, MetaValue("float64", (0,), ()))
        elif not row.nested:
            own = first.where(F.col("key") == row.key)
            if row.dtype == "string" and own.where("kind <> 'STRING'").count():
                continue
            cells = convert.typed_cells(own.select(F.col("pos").alias("idx"), "value"), row.dtype)
            _store(ds, row.key, ArrayFrame(cells, (row.n,), row.dtype), threshold)
        else:
            if second is None:
                inner = first.where("kind like 'ARRAY%'").select(F.to_json(F.struct("key", F.col("pos").alias("row"))).alias("key"), "value")
                second = _elements(inner).select(F.get_json_object("key", "$.key").alias("key"), F.get_json_object("key", "$.row").cast("bigint").alias("row"), "pos", "value", "kind")
            own = second.where(F.col("key") == row.key)
            width, name, texts, n = own.agg(F.coalesce(F.max("pos") + 1, F.lit(0)), convert.element_dtype(F.col("kind")), F.sum((F.col("kind") == "STRING").cast("int")), F.count("*")).first()
            if name == "string" and texts < n:
                continue
            cells = convert.typed_cells(own.select("row", "pos", "value").select(F.struct("row", "pos").alias("idx"), "value"), name).select("idx.row", "idx.pos", "value")
            _store(ds, row.key, _grid(cells, row.n, width, name), threshold)


def _put_structured(ds: Dataset, text: DataFrame) -> None:
    """The envelope of dtype, shape and flat data for each key."""
    keys = text.sparkSession.sql("select e.key, e.value from {text} d, lateral variant_explode(variant_get(parse_json(d.text), '$.arrays')) e", text=text)
    told = keys.select("key", F.variant_get("value", "$.dtype", "string").alias("dtype"), F.variant_get("value", "$.shape", "array<bigint>").alias("shape")).collect()
    data = _elements(keys.select("key", F.variant_get("value", "$.data", "variant").alias("value")))
    for row in told:
        cells = data.where(F.col("key") == row.key).select(F.col("pos").alias("idx"), F.variant_get("value", "$", dtype(row.dtype).spark).alias("value"))
        ds.put(row.key, ArrayFrame(cells, tuple(row.shape), row.dtype).checked())


def from_json(spark: SparkSession, source: str, path: str, config: Config | None = None, threshold: int = convert.THRESHOLD) -> Dataset:
    """A dataset of a JSON file: the structured form if it has both ``format`` and ``arrays``, else any nested object."""
    text = spark.read.text(source, wholetext=True).select(F.lit(0).cast("bigint").alias("id"), convert.strip_preamble(F.col("value")).alias("text"))
    document = F.parse_json("text")
    structured = text.select(F.variant_get(document, "$.format", "string").isNotNull() & F.variant_get(document, "$.arrays", "variant").isNotNull()).first()
    if structured is None:
        raise ValueError(f"{source}: no JSON object")
    ds = create(spark, path, config)
    if structured[0]:
        _put_structured(ds, text)
    else:
        _put_simple(ds, text, threshold)
    ds.flush()
    return ds


def to_json(ds: Dataset) -> DataFrame:
    """(key, block, json): the envelope of each array, of larger ones a header (block 0) and blocks of bounded size."""
    out = None
    for key in ds.keys():
        row = convert.envelope_blocks(ds[key]).select(F.lit(key).alias("key"), "block", "json")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("the dataset has no arrays")
    return out


def from_csv(spark: SparkSession, source: str, path: str, config: Config | None = None, key: str = "data") -> Dataset:
    ds = create(spark, path, config)
    ds.put(key, convert.csv_to_array(spark.read.text(source)))
    ds.flush()
    return ds


def to_csv(ds: Dataset, target: str) -> str:
    """The first two-dimensional array as text files of ordered lines; its key."""
    for key in ds.keys():
        if ds[key].ndim == 2:
            convert.array_to_csv(ds[key]).orderBy("row").select("line").write.text(target)
            return key
    raise ValueError("the dataset has no two-dimensional array")

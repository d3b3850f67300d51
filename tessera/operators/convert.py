"""Conversion with type inference: CSV, nested and structured JSON, and routing by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import checked
from tessera.functions.indexing import with_row_index
from tessera.operators.array import ArrayFrame

THRESHOLD = 100
#: Values in one row of an exported array at most.
ENVELOPE_CELLS = 65_536
CSV_SAMPLE = 100
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Commas with an even number of quotes behind them.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
FORMATS = {"json": "json", "csv": "csv", "msgpack": "msgpack", "mp": "msgpack", "parquet": "parquet", "nda": "dataset"}


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, '' where it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def detect_format(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    found = FORMATS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "")
    if not found:
        raise ValueError(f"no known format: {path}")
    return found


def route(n: Column, threshold: int = THRESHOLD) -> Column:
    """Where a value of n elements goes."""
    return F.when(n > threshold, "array").otherwise("metadata")


def split_csv(line: Column) -> Column:
    """The fields of a line; quoted ones lose their quotes, and doubled quotes inside count once."""
    field = lambda x: F.when(x.rlike('^".*"$'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(F.regexp_replace(x, '"', ""))
    return F.transform(F.split(line, COMMA, -1), field)


def infer_dtype(value: Column) -> Column:
    """Aggregate: string if any non-blank value is no number, else float64 if any is no integer, else int64."""
    v = F.trim(value)
    text = F.coalesce(F.max(F.when(v != "", (~v.rlike(NUMBER)).cast("int"))), F.lit(0))
    real = F.coalesce(F.max(F.when(v != "", (~v.rlike(INTEGER)).cast("int"))), F.lit(0))
    return F.when(text == 1, "string").when(real == 1, "float64").otherwise("int64")


def csv_to_array(lines: DataFrame, sample: int = CSV_SAMPLE) -> ArrayFrame:
    """lines(value) in order, without header, as a 2-D array with the first row's width.

    Blank lines are left out; short rows are filled up, long ones cut. The type follows the first ``sample`` rows;
    a later value that does not fit raises.
    """
    rows = with_row_index(lines.where(F.trim("value") != "").select(split_csv(F.col("value")).alias("fields")))
    first = rows.where("idx = 0").select(F.size("fields")).first()
    width, n = (first[0] if first else 0), rows.count()
    name = rows.where(F.col("idx") < sample).select(F.explode("fields").alias("x")).agg(infer_dtype(F.col("x")).alias("t")).first()["t"]
    grid = rows.select("idx", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda k: F.coalesce(F.get("fields", k), F.lit("")))).alias("c", "x"))
    blank = "" if name == "string" else "0"
    text = F.when(F.trim("x") == "", F.lit(blank)).otherwise(F.col("x") if name == "string" else F.trim("x"))
    value = text if name == "string" else text.cast("bigint" if name == "int64" else "double")
    cells = grid.select((F.col("idx") * F.lit(width).cast("bigint") + F.col("c")).alias("idx"), value.alias("value"))
    return ArrayFrame(cells, (n, width), name)


def csv_field(value: Column, name: str) -> Column:
    text = value.cast("string")
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text) if name == "string" else text


def array_to_csv(array: ArrayFrame) -> DataFrame:
    """(row, line) of a 2-D array, in full precision, fields quoted where needed."""
    if array.ndim != 2:
        raise ValueError(f"CSV takes a 2-D array, not {array.ndim} dimensions")
    cells = array.coordinates().select(F.col("i0").alias("row"), F.struct("i1", csv_field(F.col("value"), array.dtype).alias("x")).alias("cell"))
    return cells.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c["x"]), ",").alias("line"))


def envelope(array: ArrayFrame) -> DataFrame:
    """One row: the array as the JSON of dtype, shape and flat data; for arrays that fit one row."""
    data = F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda c: c["value"])
    shape = F.array(*[F.lit(n).cast("bigint") for n in array.shape]).cast("array<bigint>")
    return array.cells.agg(F.to_json(F.struct(F.lit(array.dtype).alias("dtype"), shape.alias("shape"), data.alias("data"))).alias("json"))


def envelope_blocks(array: ArrayFrame, cells: int = ENVELOPE_CELLS) -> DataFrame:
    """(block, json): the envelope of a small array, else a header as block 0 and its data in blocks of so many cells.

    No row holds more than ``cells`` values. The header counts the blocks; block k has the cells from (k - 1) * cells.
    """
    if array.size <= cells:
        return envelope(array).select(F.lit(0).cast("bigint").alias("block"), "json")
    shape = F.array(*[F.lit(n).cast("bigint") for n in array.shape]).cast("array<bigint>")
    header = F.to_json(F.struct(F.lit(array.dtype).alias("dtype"), shape.alias("shape"), F.lit(-(-array.size // cells)).cast("bigint").alias("blocks")))
    first = array.cells.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("block"), header.alias("json"))
    block = F.call_function("div", F.col("idx"), F.lit(cells).cast("bigint")) + F.lit(1).cast("bigint")
    data = F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda c: c["value"])
    return first.unionByName(array.cells.groupBy(block.alias("block")).agg(F.to_json(F.struct(data.alias("data"))).alias("json")))


def strip_preamble(text: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def flatten_json(docs: DataFrame) -> DataFrame:
    """docs(id, text) as (id, key, kind, value): each leaf of the nested objects under its path of keys.

    ``value`` is a VARIANT, ``kind`` its type; nulls are left out. One level of objects is opened per round, until
    none is left, so the number of rounds is the nesting depth.
    """
    rows = docs.select("id", F.lit(None).cast("string").alias("key"), F.parse_json(strip_preamble(F.col("text"))).alias("value"))
    leaves = None
    while True:
        rows = rows.withColumn("kind", F.schema_of_variant("value"))
        found = rows.where("kind not like 'OBJECT%' and kind <> 'VOID'").select("id", "key", "kind", "value")
        leaves = found if leaves is None else leaves.unionByName(found)
        objects = rows.where("kind like 'OBJECT%'")
        if objects.isEmpty():
            return leaves
        rows = objects.sparkSession.sql("select o.id, concat_ws('/', o.key, e.key) as key, e.value as value from {objects} o, lateral variant_explode(o.value) e", objects=objects)


def element_dtype(kind: Column) -> Column:
    """Aggregate over the kinds of a JSON array's elements: any that is no number makes strings, any fraction float64."""
    return (
        F.when(F.count(kind) == 0, "float64")
        .when(F.max((~kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")).cast("int")) == 1, "string")
        .when(F.max((kind != "BIGINT").cast("int")) == 1, "float64")
        .otherwise("int64")
    )


def padded_grid(ragged: DataFrame, fill: object) -> DataFrame:
    """ragged(key, items) as (key, pos, value): every row as wide as the widest, filled up."""
    width = ragged.agg(F.max(F.size("items"))).first()[0] or 0
    if not width:
        return ragged.limit(0).select("key", F.lit(0).cast("bigint").alias("pos"), F.lit(fill).alias("value"))
    wide = ragged.select("key", "items", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("pos"))
    return wide.select("key", F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.get("items", "pos"), F.lit(fill)).alias("value"))


def typed_cells(values: DataFrame, name: str) -> DataFrame:
    """(idx, value VARIANT) as cells of a dtype."""
    spark_type = {"int64": "bigint", "float64": "double", "string": "string"}[name]
    return values.select("idx", checked(F.variant_get("value", "$", spark_type), name).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)

"""A stored dataset: arrays, metadata and layers below one folder, changed by new versions of a small state table.

``state/version=N`` holds one row per array, metadata entry and layer. A flush writes the changed cells under new names
and then one new version, so readers see the old or the new state, never a mix; a version is whole when it has as many
rows as each of its rows says. Cells are Parquet sorted by index, with row groups of the block size, so that slices
read only the row groups that their index ranges touch. Arrays below PACK elements share one table per element type
and flush.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from uuid import uuid4

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import dtype
from tessera.operators import inspect as inspection
from tessera.operators.array import ArrayFrame, from_numpy
from tessera.operators.codec import DEFAULT_BLOCK, PLANES, elements_per_block, pack_planes, parquet_codec, unpack_planes, uses_shuffle
from tessera.operators.metadata import BASE, MetaValue

PACK = 1 << 16
FILE_BYTES = 1 << 27
BYTES_LIMIT = 1 << 28
FORMAT = 2
STATE = "kind string, layer string, key string, ord bigint, dtype string, shape array<bigint>, codec string, block_bytes bigint, path string, array_id bigint, v struct<i:array<bigint>,u:array<decimal(20,0)>,f:array<float>,d:array<double>,s:array<string>>, format int, n_rows bigint"
READ, WRITE = ("r", "read"), ("w", "write", "rw", "a")


@dataclass(frozen=True)
class Config:
    """How arrays are stored. Shuffled codecs, the default among them, store the byte planes of whole blocks: numbers
    compress better, and no slice can be pushed down to them, so they are not sliced.
    """

    codec: str = "lz4_shuffle"
    block_bytes: int = DEFAULT_BLOCK
    layer_inheritance: bool = False


@dataclass
class Entry:
    dtype: str
    shape: tuple[int, ...]
    codec: str
    block_bytes: int
    ord: int
    path: str = ""
    array_id: int = 0
    pending: ArrayFrame | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) if self.shape else 1


    @property
    def in_planes(self) -> bool:
        """Whether it is stored as blocks of byte planes; texts have no fixed size and never are."""
        return uses_shuffle(self.codec) and self.dtype != "string"


class Metadata:
    """A layer's small values, like a dict."""

    def __init__(self, dataset: Dataset, layer: str):
        self._dataset, self._layer = dataset, layer

    def _own(self) -> dict[str, MetaValue]:
        return self._dataset._meta.setdefault(self._layer, {})

    def _shown(self) -> dict[str, MetaValue]:
        inherited = self._dataset._meta.get(BASE, {}) if self._layer != BASE and self._dataset.layer_inheritance else {}
        return self._own() | {k: v for k, v in inherited.items() if k not in self._own()}

    def put(self, key: str, value: object) -> None:
        self._dataset._change()
        self._own()[key] = MetaValue.of(value)

    def put_batch(self, values: Mapping[str, object]) -> None:
        for key, value in values.items():
            self.put(key, value)

    def value(self, key: str) -> MetaValue | None:
        return self._shown().get(key)

    def get(self, key: str, default: object = None) -> object:
        found = self.value(key)
        return default if found is None else found.native()

    def get_batch(self, keys: Iterable[str]) -> dict[str, MetaValue]:
        shown = self._shown()
        return {k: shown[k] for k in sorted(set(keys)) if k in shown}

    def get_all(self) -> dict[str, MetaValue]:
        return dict(sorted(self._shown().items()))

    def remove(self, key: str) -> None:
        self._dataset._change()
        self._own().pop(key, None)

    def clear(self) -> None:
        self._dataset._change()
        self._own().clear()

    def keys(self) -> list[str]:
        return sorted(self._shown())

    def __getitem__(self, key: str) -> object:
        if key not in self:
            raise KeyError(key)
        return self.get(key)

    __setitem__ = put

    def __contains__(self, key: str) -> bool:
        return key in self._shown()

    def __len__(self) -> int:
        return len(self._shown())

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())


class Layer:
    """A named overlay of a dataset's keys."""

    def __init__(self, dataset: Dataset, name: str):
        self._dataset, self.name, self.meta = dataset, name, Metadata(dataset, name)

    @property
    def base(self) -> Dataset:
        return self._dataset

    def put(self, key: str, array: object) -> None:
        self._dataset._put(self.name, key, array)

    def get(self, key: str, name: str | None = None) -> ArrayFrame:
        for layer in (self.name, BASE) if self._dataset.layer_inheritance else (self.name,):
            if (layer, key) in self._dataset._entries:
                return self._dataset._get(layer, key, name)
        raise KeyError(key)

    def contains(self, key: str) -> bool:
        layers = (self.name, BASE) if self._dataset.layer_inheritance else (self.name,)
        return any((layer, key) in self._dataset._entries for layer in layers) or key in self.meta

    def keys(self) -> list[str]:
        shown = [k for layer, k in self._dataset._entries if layer == self.name]
        if self._dataset.layer_inheritance:
            shown += [k for layer, k in self._dataset._entries if layer == BASE]
        return list(dict.fromkeys([*shown, *self.meta.keys()]))

    def __getitem__(self, key: str) -> ArrayFrame:
        return self.get(key)

    __setitem__ = put
    __contains__ = contains

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())


class Dataset:
    def __init__(self, spark: SparkSession, root: str | None, config: Config, read_only: bool, version: int):
        self.spark, self.root, self.config, self.read_only, self.version = spark, root, config, read_only, version
        self.layer_inheritance = config.layer_inheritance
        self._entries: dict[tuple[str, str], Entry] = {}
        self._meta: dict[str, dict[str, MetaValue]] = {BASE: {}}
        self._layers: list[str] = []
        self._dirty = False
        self.meta = Metadata(self, BASE)

    # arrays

    def _change(self) -> None:
        if self.read_only:
            raise PermissionError("the dataset is open for reading only")
        self._dirty = True

    def _put(self, layer: str, key: str, array: object) -> None:
        self._change()
        if not isinstance(array, ArrayFrame):
            if isinstance(array, (str, bytes, int, float, bool)):
                raise TypeError("a scalar or text goes to meta, not to the arrays")
            array = from_numpy(self.spark, array)
        old = self._entries.get((layer, key))
        order = old.ord if old else 1 + max((e.ord for e in self._entries.values()), default=-1)
        elements_per_block(self.config.block_bytes, array.dtype)
        parquet_codec(self.config.codec)
        self._entries[layer, key] = Entry(array.dtype, array.shape, self.config.codec, self.config.block_bytes, order, pending=array)

    def _get(self, layer: str, key: str, name: str | None = None) -> ArrayFrame:
        if (layer, key) not in self._entries:
            raise KeyError(key)
        e = self._entries[layer, key]
        if e.pending is not None:
            array = e.pending
        else:
            if e.in_planes:
                blocks = self.spark.read.schema(PLANES).parquet(f"{self.root}/{e.path}").where(F.col("array_id") == e.array_id)
                cells = blocks.mapInArrow(unpack_planes(e.dtype, elements_per_block(e.block_bytes, e.dtype)), f"array_id bigint, idx bigint, value {dtype(e.dtype).spark}")
                array = ArrayFrame(cells.select("idx", "value"), e.shape, e.dtype)
                return array.typed(name) if name else array
            cells = self.spark.read.schema(f"array_id bigint, idx bigint, value {dtype(e.dtype).spark}").parquet(f"{self.root}/{e.path}")
            array = ArrayFrame(cells.where(F.col("array_id") == e.array_id).select("idx", "value"), e.shape, e.dtype)
        return array.typed(name) if name else array

    def put(self, key: str, array: object) -> None:
        self._put(BASE, key, array)

    def get(self, key: str, name: str | None = None) -> ArrayFrame:
        """The array under a key; with ``name``, only if that is its element type."""
        return self._get(BASE, key, name)

    __getitem__ = get
    __setitem__ = put

    def get_slice(self, key: str, slices: Sequence, allow_nd: bool = False) -> ArrayFrame:
        if (BASE, key) not in self._entries:
            raise ValueError(f"{key} is metadata; read it with meta[...]") if key in self.meta else KeyError(key)
        e = self._entries[BASE, key]
        if uses_shuffle(e.codec):
            raise ValueError(f"{key}: arrays stored with {e.codec} can't be sliced; store it with {e.codec.removesuffix('_shuffle')}")
        return self._get(BASE, key).slice(slices, allow_nd)

    def is_sliceable(self, key: str) -> bool:
        e = self._entries.get((BASE, key))
        return e is not None and e.pending is None and not uses_shuffle(e.codec)

    def dtype_of(self, key: str) -> str:
        return self._entries[BASE, key].dtype

    def __contains__(self, key: str) -> bool:
        return (BASE, key) in self._entries or key in self.meta

    def keys(self) -> list[str]:
        return [k for (layer, k), _ in sorted(self._entries.items(), key=lambda x: x[1].ord) if layer == BASE]

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    # metadata of all layers

    def metadata_keys(self) -> list[str]:
        return sorted({k for values in self._meta.values() for k in values})

    def metadata_count(self) -> int:
        return sum(map(len, self._meta.values()))

    # layers

    def create_layer(self, name: str) -> Layer:
        if name == BASE or name in self._layers:
            raise ValueError(f"layer already exists: {name}")
        self._change()
        self._layers.append(name)
        return Layer(self, name)

    def get_layer(self, name: str) -> Layer:
        if not self.has_layer(name):
            raise KeyError(name)
        return Layer(self, name)

    def has_layer(self, name: str) -> bool:
        return name == BASE or name in self._layers

    def list_layers(self) -> list[str]:
        return list(self._layers)

    def key_in_layer(self, key: str, layer: str) -> bool:
        return (layer, key) in self._entries or key in self._meta.get(layer, {})

    # tables

    def catalog(self) -> DataFrame:
        rows = [(layer, k, e.dtype, list(e.shape), dtype(e.dtype).size, e.codec, e.block_bytes, e.pending is None and not uses_shuffle(e.codec), e.ord) for (layer, k), e in self._entries.items()]
        return self.spark.createDataFrame(rows, "layer string, key string, dtype string, shape array<bigint>, elem_size int, codec string, block_bytes bigint, sliceable boolean, ord bigint")

    def metadata_table(self) -> DataFrame:
        from tessera.operators.metadata import SCHEMA

        return self.spark.createDataFrame([v.row(layer, k) for layer, values in self._meta.items() for k, v in values.items()], SCHEMA)

    def show(self, key: str, force: bool = False) -> str:
        """The first elements of an array, as text."""
        if (BASE, key) not in self._entries:
            raise KeyError(f"{key}; there are {', '.join(self.keys()) or 'no arrays'}")
        e = self._entries[BASE, key]
        if e.size * dtype(e.dtype).size > inspection.PRINT_LIMIT and not force:
            raise MemoryError(f"{key} is large; pass force=True to print it")
        rows = inspection.head(self.get(key).cells).orderBy("idx").collect()
        return inspection.printed([r["value"] for r in rows], e.size, e.dtype == "string")

    # storage

    def _write(self, arrays: list[tuple[Entry, ArrayFrame]], path: str, codec: str, block_bytes: int) -> None:
        frames = [a.cells.select(F.lit(e.array_id).cast("bigint").alias("array_id"), "idx", "value") for e, a in arrays]
        while len(frames) > 1:  # a balanced tree of unions, so that plans stay shallow
            frames = [frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
        n_bytes = sum(e.size * max(16, dtype(e.dtype).size) for e, _ in arrays)
        files = max(1, -(-n_bytes // FILE_BYTES))
        planes, per_block = arrays[0][0].in_planes, elements_per_block(block_bytes, arrays[0][0].dtype)
        place = F.call_function("div", F.col("idx"), F.lit(per_block).cast("bigint")) if planes else F.col("idx")  # whole blocks stay together
        dealt = (frames[0].repartitionByRange(files, F.col("array_id"), place) if files > 1 else frames[0].coalesce(1)).sortWithinPartitions("array_id", "idx")
        if planes:
            dealt = dealt.mapInArrow(pack_planes(arrays[0][0].dtype, per_block), PLANES)
        dealt.write.option("compression", parquet_codec(codec)).option("parquet.block.size", block_bytes).parquet(f"{self.root}/{path}")

    def flush(self) -> None:
        """Write what has changed; no-op when nothing has."""
        if not self._dirty:
            return
        self._change()
        if self.root is None:
            raise PermissionError("a dataset in memory can't be flushed; use save_to")
        packs: dict[tuple, list] = {}
        for e in self._entries.values():
            if e.pending is not None:
                alone = e.size > PACK
                packs.setdefault((e.dtype, e.codec, e.block_bytes, id(e) if alone else 0), []).append((e, e.pending))
        for (_, codec, block_bytes, _), arrays in packs.items():
            path = f"cells/{uuid4().hex}"
            for k, (e, _) in enumerate(arrays):
                e.array_id = k
            self._write(arrays, path, codec, block_bytes)
            for e, _ in arrays:
                e.path, e.pending = path, None
        self._write_state()
        self._dirty = False

    def _write_state(self) -> None:
        none = (None,) * 5
        rows = [("layer", name, None, k, None, None, None, None, None, None, none) for k, name in enumerate([BASE, *self._layers])]
        rows += [("array", layer, k, e.ord, e.dtype, list(e.shape), e.codec, e.block_bytes, e.path, e.array_id, none) for (layer, k), e in self._entries.items()]
        for layer, values in self._meta.items():
            for k, v in values.items():
                _, _, name, shape, slots = v.row(layer, k)
                rows.append(("meta", layer, k, None, name, shape, None, None, None, None, slots))
        table = self.spark.createDataFrame([(*r, FORMAT, len(rows)) for r in rows], STATE)
        try:
            table.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/state/version={self.version + 1}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            raise RuntimeError(f"{self.root}: another writer has flushed version {self.version + 1}; open it again and repeat the changes") from e
        self.version += 1

    def close(self) -> None:
        if not self.read_only and self.root is not None:
            self.flush()

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def save_to(self, path: str, config: Config | None = None) -> Dataset:
        """A copy with every array rewritten, in this dataset's codecs or those of ``config``."""
        if self.root is not None and path.rstrip("/") == self.root.rstrip("/"):
            raise ValueError("a dataset can't be saved onto itself")
        copy = create(self.spark, path, config or self.config)
        copy._layers = list(self._layers)
        copy._meta = {layer: dict(values) for layer, values in self._meta.items()}
        for (layer, key), e in self._entries.items():
            codec, block = (config.codec, config.block_bytes) if config else (e.codec, e.block_bytes)
            copy._entries[layer, key] = replace(e, codec=codec, block_bytes=block, path="", pending=self._get(layer, key))
        copy._dirty = True
        copy.flush()
        return copy

    def reorganize(self, path: str, threshold: int = 100) -> Dataset:
        """A copy in which every value goes to the arrays if it has more than ``threshold`` elements, else to metadata."""
        copy = create(self.spark, path, self.config)
        copy._layers = list(self._layers)
        for (layer, key), e in self._entries.items():
            if e.size > threshold:
                copy._put(layer, key, self._get(layer, key))
            else:
                copy._meta.setdefault(layer, {})[key] = MetaValue.of(self._get(layer, key).to_numpy())
        for layer, values in self._meta.items():
            for key, v in values.items():
                if v.size > threshold:
                    copy._put(layer, key, v.to_numpy())
                elif (layer, key) not in self._entries:
                    copy._meta.setdefault(layer, {})[key] = v
        copy._dirty = True
        copy.flush()
        return copy

    def write_bytes(self, most: int = BYTES_LIMIT) -> bytes:
        """The dataset as one zip, for small ones: it goes through the driver, so its size is checked first."""
        total = sum(e.size * max(8, dtype(e.dtype).size) for e in self._entries.values())
        if total > most:
            raise MemoryError(f"{total} bytes; write_bytes takes up to {most}; use save_to")
        out, listed = io.BytesIO(), []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
            for n, ((layer, key), e) in enumerate(self._entries.items()):
                values = self._get(layer, key).to_numpy(force=True)
                listed.append([layer, key, e.dtype, list(e.shape), e.codec, e.block_bytes, e.ord])
                file.writestr(f"{n}", json.dumps(values.ravel().tolist()) if e.dtype == "string" else values.tobytes())
            meta = [[layer, k, v.dtype, list(v.shape), list(v.data)] for layer, values in self._meta.items() for k, v in values.items()]
            file.writestr("state.json", json.dumps({"format": FORMAT, "arrays": listed, "meta": meta, "layers": self._layers}))
        return out.getvalue()


def _latest(spark: SparkSession, root: str) -> tuple[int, list]:
    """The last whole version and its rows; version 0 where there is none."""
    try:
        table = spark.read.schema(f"{STATE}, version bigint").parquet(f"{root}/state")
        whole = table.groupBy("version").agg(F.count("*").alias("n"), F.max("n_rows").alias("said"), F.max("format").alias("format")).where("n = said").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0, []
        raise ValueError(f"{root}: corrupt, or not a dataset") from e
    if whole is None:
        raise ValueError(f"{root}: corrupt, or not a dataset")
    if whole["format"] != FORMAT:
        raise ValueError(f"{root}: unknown format {whole['format']}")
    return whole["version"], table.where(F.col("version") == whole["version"]).collect()


def create(spark: SparkSession, path: str, config: Config | None = None) -> Dataset:
    """An empty dataset in place of what the path holds; that stays readable until the first flush."""
    from tessera.sources.paths import require_writable

    root = require_writable(path)
    dataset = Dataset(spark, root, config or Config(), False, _latest(spark, root)[0])
    dataset._dirty = True
    return dataset


def open_dataset(spark: SparkSession, path: str, mode: str = "r", config: Config | None = None) -> Dataset:
    """An existing dataset for reading, or an existing or new one for writing."""
    from tessera.sources.paths import parse_path, require_writable

    if mode not in (*READ, *WRITE):
        raise ValueError(f"unknown mode {mode!r}")
    root = parse_path(path).uri if mode in READ else require_writable(path)
    version, rows = _latest(spark, root)
    if not version and mode in READ:
        raise FileNotFoundError(path)
    dataset = Dataset(spark, root, config or Config(), mode in READ, version)
    for r in sorted(rows, key=lambda r: r["ord"] or 0):
        if r["kind"] == "layer" and r["layer"] != BASE:
            dataset._layers.append(r["layer"])
        elif r["kind"] == "array":
            dataset._entries[r["layer"], r["key"]] = Entry(r["dtype"], tuple(r["shape"]), r["codec"], r["block_bytes"], r["ord"], r["path"], r["array_id"])
        elif r["kind"] == "meta":
            dataset._meta.setdefault(r["layer"], {})[r["key"]] = MetaValue.of_row(r)
    return dataset


def open_bytes(spark: SparkSession, data: bytes, config: Config | None = None) -> Dataset:
    """A read-only dataset from what write_bytes made."""
    try:
        file = zipfile.ZipFile(io.BytesIO(bytes(data)))
        state = json.loads(file.read("state.json"))
    except (zipfile.BadZipFile, KeyError, ValueError) as e:
        raise ValueError("corrupt, or not a dataset") from e
    dataset = Dataset(spark, None, config or Config(), True, 0)
    dataset._layers = state["layers"]
    for n, (layer, key, name, shape, codec, block_bytes, order) in enumerate(state["arrays"]):
        raw = file.read(f"{n}")
        values = np.array(json.loads(raw), object) if name == "string" else np.frombuffer(raw, name)
        dataset._entries[layer, key] = Entry(name, tuple(shape), codec, block_bytes, order, pending=from_numpy(spark, values.reshape(shape)))
    for layer, key, name, shape, values in state["meta"]:
        dataset._meta.setdefault(layer, {})[key] = MetaValue(name, tuple(shape), tuple(values))
    return dataset

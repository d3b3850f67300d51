"""python -m tessera convert SOURCE TARGET [-c CODEC] [-b BLOCK_BYTES] [-t THRESHOLD] | show DATASET [KEY]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.operators import inspect
from tessera.operators.convert import THRESHOLD, detect_format
from tessera.sources.dataset import Config, open_dataset
from tessera.sources.files import from_csv, from_json, to_csv, to_json


def convert(spark: SparkSession, source: str, target: str, config: Config, threshold: int) -> str:
    """From and to by extension: json, csv, and nda for datasets."""
    pair = detect_format(source), detect_format(target)
    if pair == ("json", "dataset"):
        from_json(spark, source, target, config, threshold)
    elif pair == ("csv", "dataset"):
        from_csv(spark, source, target, config)
    elif pair == ("dataset", "dataset"):
        open_dataset(spark, source).save_to(target, config)
    elif pair == ("dataset", "json"):
        to_json(open_dataset(spark, source)).write.json(target)
    elif pair == ("dataset", "csv"):
        to_csv(open_dataset(spark, source), target)
    else:
        raise ValueError(f"no conversion from {pair[0]} to {pair[1]}")
    return " to ".join(pair)


def show(spark: SparkSession, path: str, key: str | None, force: bool) -> str:
    ds = open_dataset(spark, path)
    if key is None:
        lines = [f"{r.layer}/{r.key}: {r.dtype} {list(r.shape)}, {r.n_elements} elements, {r.n_bytes} bytes, {r.n_blocks} blocks, {r.codec}" for r in inspect.listing(ds.catalog()).collect()]
        return "\n".join(lines + [f"{k} = {v.native()!r}" for k, v in ds.meta.get_all().items()])
    return repr(ds.meta[key]) if key in ds.meta and key not in ds.keys() else ds.show(key, force)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("-c", "--codec", default="lz4")
    one.add_argument("-b", "--block-bytes", type=int, default=1 << 20)
    one.add_argument("-t", "--threshold", type=int, default=THRESHOLD)
    two = commands.add_parser("show")
    two.add_argument("path")
    two.add_argument("key", nargs="?")
    two.add_argument("-f", "--force", action="store_true")
    told = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    print(convert(spark, told.source, told.target, Config(told.codec, told.block_bytes), told.threshold) if told.command == "convert" else show(spark, told.path, told.key, told.force))


if __name__ == "__main__":
    main()

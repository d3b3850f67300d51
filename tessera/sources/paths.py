"""Where a dataset is: local folders, object stores and HTTP."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Prefixes that name a store in front of a path.
S3_PREFIXES = ("/vsis3/", "s3://", "s3a://")
HTTP_PREFIX = "/vsicurl/"


@dataclass(frozen=True)
class Location:
    kind: str
    uri: str
    bucket: str = ""
    key: str = ""
    region: str = ""

    @property
    def writable(self) -> bool:
        return self.kind != "http"


def parse_path(path: str) -> Location:
    """The store of a path, and the URI under which Spark reads it."""
    for prefix in S3_PREFIXES:
        if path.startswith(prefix):
            bucket, _, key = path[len(prefix) :].partition("/")
            if not bucket or not key:
                raise ValueError(f"{path}: an object path has a bucket and a key")
            region = os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION") or "us-east-1"
            return Location("s3", f"s3a://{bucket}/{key}", bucket, key, region)
    plain = path.removeprefix(HTTP_PREFIX)
    if plain.startswith(("http://", "https://")):
        return Location("http", plain)
    if plain != path:
        raise ValueError(f"{path}: no URL behind {HTTP_PREFIX}")
    return Location("hadoop" if "://" in path and not path.startswith("file:") else "local", path)


def require_writable(path: str) -> str:
    place = parse_path(path)
    if not place.writable:
        raise ValueError(f"{path}: HTTP is read only")
    return place.uri


def configure_s3(spark: SparkSession) -> None:
    """The usual environment variables of other S3 tools as settings of s3a."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if endpoint := os.environ.get("AWS_S3_ENDPOINT"):
        conf.set("fs.s3a.endpoint", endpoint)
    truth = lambda name: os.environ.get(name, "").lower() not in ("false", "no", "off", "0")
    conf.set("fs.s3a.path.style.access", str(not truth("AWS_VIRTUAL_HOSTING")).lower())
    conf.set("fs.s3a.connection.ssl.enabled", str(truth("AWS_HTTPS")).lower())


def store_of(path: Column) -> Column:
    """The kind of store of each path of a column."""
    return F.when(path.rlike("^(/vsis3/|s3a?://)"), "s3").when(path.rlike("^(/vsicurl/)?https?://"), "http").when(path.rlike("^(?!file:)[a-z0-9]+://"), "hadoop").otherwise("local")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)

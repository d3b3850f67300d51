"""Sharding by extendible hashing, with DataFrame functions only.

A document's key hash has BITS bits. The directory is indexed by hash prefixes: a bucket of depth d holds all documents
whose first d bits agree, and only buckets above the byte limit are split on another bit. Because a document's
ancestors are fixed by its hash, the whole directory follows from sums over prefixes: a document's bucket is its
shallowest prefix that fits. Sums are taken at one fine depth first and rolled up; only buckets that are still too
large at that depth are looked at again, some bits deeper.

A bucket whose documents all have the same hash can't be split by bits; if it is above the limit, it goes into overflow
pages of equal numbers of rows that fit (one row a page where a single row does not).

Defined cases: a null text has 0 bytes; null keys share one hash and repeated keys theirs, and may need pages; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skew_join, work_uri
from tessera.llm.systematic import numbered

BITS = 60


def key_hash(key: str = "doc_id") -> Column:
    """The first 60 bits of the md5 of the key's text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(depth: Column | int) -> Column:
    return F.expr("shiftright(h, 60 - {0})".format(depth)) if isinstance(depth, int) else F.call_function("shiftright", F.col("h"), F.lit(BITS) - depth)


def _buckets(rows: DataFrame, limit: int, low: int, high: int, uri: str) -> DataFrame:
    """(p, depth, bytes, n, same) for each prefix p of ``high`` bits; depth is null where more bits are needed.

    ``n`` counts the rows of p, the other numbers are of the bucket.
    """
    fine = materialize(rows.groupBy(prefix(high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("n_bytes").alias("most")), f"{uri}-fine")
    every = fine.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("a", F.expr(f"shiftright(p, {high} - d)"))
    sums = every.groupBy("d", "a").agg(F.sum("b").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("most").alias("most"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "a", "bytes", "most", (F.col("lo") == F.col("hi")).alias("same"))
    chosen = every.select("p", "d", "a").join(fits, ["d", "a"]).groupBy("p").agg(F.min(F.struct("d", "bytes", "most", "same")).alias("bucket"))
    return materialize(fine.select("p", "n").join(chosen, "p", "left").select("p", "n", F.col("bucket.d").alias("depth"), F.col("bucket.bytes").alias("bucket_bytes"), F.col("bucket.most").alias("most"), F.col("bucket.same").alias("same")), f"{uri}-buckets")


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", step: int = 8) -> DataFrame:
    """(key, n_bytes, depth, prefix, page, bucket_bytes) for each row of docs(key, text).

    A shard is a (depth, prefix, page); ``page`` is 0 but in overflowing buckets. The directory's depth is the largest
    ``depth``.
    """
    uri = work_uri(docs.sparkSession, "extendible")
    sized = docs.select(F.col(key), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key_hash(key).alias("h"))
    rows = materialize(sized.withColumn("_row", F.monotonically_increasing_id()), f"{uri}/rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high, done = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes)))) + 3), []
    while True:
        buckets = _buckets(rows, limit_bytes, low, high, f"{uri}/{high}")
        placed = skew_join(rows.withColumn("p", prefix(high)), buckets, "p", "n", ["_row"])
        done.append(placed.where("depth is not null"))
        if buckets.where("depth is null").isEmpty():
            break
        rows = materialize(placed.where("depth is null").select(*rows.columns), f"{uri}/{high}-rest")
        low, high = high + 1, min(BITS, high + step)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    whole = whole.withColumn("prefix", prefix(F.col("depth").cast("int")))
    over = F.col("same") & (F.col("bucket_bytes") > limit_bytes)
    plain = whole.where(~over).withColumn("page", F.lit(0).cast("long"))
    paged = materialize(whole.where(over).withColumn("_group", F.concat_ws("/", "depth", "prefix")), f"{uri}/overflow")
    per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit_bytes) / F.greatest(F.col("most"), F.lit(1))))
    paged = numbered(paged, "_group", ["n_bytes", "_row"]).withColumn("page", F.floor(F.col("rank") / per_page).cast("long"))
    columns = [key, "n_bytes", "depth", "prefix", "page", "bucket_bytes"]
    return plain.select(*columns).unionByName(paged.select(*columns))

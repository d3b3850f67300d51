"""WARC archives and the resolution of revisits.

``write_archives`` writes one gzip member per page; ``read_records`` lists the records and checks each response against its digest; ``resolve`` shuffles the headers
(never the payloads) by payload digest and joins every later record to the first response of its digest;
``write_deduplicated`` copies the archives, with responses kept and revisits written without payload, under fresh
headers.

Record order within a digest is (page id, archive, offset), null ids last: the first is the response, so of repeated
rows one is the response and the others revisit it. Payloads smaller than ``least`` bytes are always responses.

Defined cases: a null html is an empty payload; a null url leaves out the target header; a null page id leaves out the
row header and comes back as null; line ends in urls are percent-encoded; an empty table gives empty archives and an
empty result; other columns are ignored. Files count only if the written manifest lists them, so retried tasks leave
at most unlisted files. Memory holds one record at a time, besides Arrow's batch.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skew_join, work_uri

ARCHIVE_BYTES = 1 << 27
GZIP_LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW, REFERS_ROW = "X-Row-ID", "X-Refers-To-Row-ID"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, repr(what))}>"


def record(kind: str, fields: list[tuple[str, object]], length: int, payload: bytes | None) -> bytes:
    """One gzip member: a WARC record of an HTTP response, without its payload for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", kind), *((k, v) for k, v in fields if v is not None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: dict(x.decode().split(": ", 1) for x in lines[1:] if b": " in x)
    warc = fields(head.split(b"\r\n"))
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")), payload


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes, unpacked record) of each gzip member of an open file, read in pieces."""
    at, held = 0, b""
    while True:
        if not held:
            held = source.read(1 << 20)
            if not held:
                return
        unpack, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(unpack.decompress(held))
            if unpack.eof:
                used += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
                break
            used += len(held)
            held = source.read(1 << 20)
            if not held:
                raise ValueError(f"archive ends within the record at {at}")
        yield at, used, b"".join(out)
        at += used


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Archives:
    """Numbered archive files of one task, rolled over at a size."""

    def __init__(self, uri: str):
        self.uri, self.out, self.at, self.name, self.done = uri, None, 0, "", []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name, self.at = f"{self.uri}/{uuid4().hex}.warc.gz", 0
            files, path = _open(self.name)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = files.open_output_stream(path, compression=None)
        self.out.write(raw)
        self.at += len(raw)
        if self.at >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.at))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        names, sizes = zip(*self.done, strict=True) if self.done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write a response record per row of pages(page_id, url, html); the manifest (path, n_bytes)."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, task, k = Archives(f"{uri}/archives"), uuid4().hex, 0
        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                digest = payload_digest(payload)
                fields = [("WARC-Record-ID", record_id(task, k)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), (ROW, page_id)]
                archives.add(record("response", fields, len(payload), payload))
                k += 1
        yield archives.manifest()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialize(rows.mapInArrow(per_partition, "path string, n_bytes long"), f"{uri}/manifest")


HEADERS = "path string, offset long, n_bytes long, page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, target string, date string"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in HEADERS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in HEADERS.split(", ")]
    whole = lambda x: None if x is None else int(x)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows = []
            files, path = _open(name)
            with files.open_input_stream(path, compression=None) as source:
                for at, n, raw in members(source):
                    warc, http, payload = parse(raw)
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{name}: the payload at {at} does not have its digest")
                    rows.append((name, at, n, whole(warc.get(ROW)), warc["WARC-Record-ID"], warc["WARC-Type"], int(http["Content-Length"]), digest, whole(warc.get(REFERS_ROW)), warc.get("WARC-Target-URI"), warc["WARC-Date"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """The headers of all records of the listed archives; responses are checked against their digests."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(_headers, HEADERS)


def resolve(headers: DataFrame, uri: str, least: int = 0) -> DataFrame:
    """headers (a written table) with record_type and what a revisit refers to decided anew."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset", "record_id", "target", "date")
    firsts = materialize(headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")), f"{uri}/firsts")
    plain = headers.drop("record_type", "refers_to")
    joined = skew_join(plain, firsts, "payload_digest", "n", ["path", "offset"])
    again = (F.col("payload_bytes") >= least) & ~((F.col("first.path") == F.col("path")) & (F.col("first.offset") == F.col("offset")))
    return joined.select(*plain.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"), *[F.when(again, F.col(f"first.{c}")).alias(n) for c, n in (("record_id", "refers_record"), ("target", "refers_target"), ("date", "refers_date"))])


def write_deduplicated(resolved: DataFrame, uri: str) -> DataFrame:
    """Copy the records that ``resolved`` lists into new archives, with payloads for responses only; the manifest.

    Rows are dealt by archive and sorted by offset, so each task reads whole archives, one after another, in order.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, name, source = Archives(f"{uri}/archives"), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != name:
                    if source is not None:
                        source.close()
                    name = row["path"]
                    files, path = _open(name)
                    source = files.open_input_file(path)
                source.seek(row["offset"])
                warc, http, payload = parse(zlib.decompress(source.read(row["n_bytes"]), 31))
                kind = row["record_type"]
                fields = [("WARC-Record-ID", record_id(kind, warc["WARC-Record-ID"])), ("WARC-Date", warc["WARC-Date"]), ("WARC-Target-URI", warc.get("WARC-Target-URI")), ("WARC-Payload-Digest", warc["WARC-Payload-Digest"]), (ROW, warc.get(ROW))]
                if kind == "revisit":
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", row["refers_record"])), ("WARC-Refers-To-Target-URI", row["refers_target"]), ("WARC-Refers-To-Date", row["refers_date"]), (REFERS_ROW, row["refers_to"])]
                archives.add(record(kind, fields, int(http["Content-Length"]), payload if kind == "response" else None))
        if source is not None:
            source.close()
        yield archives.manifest()

    parts = int(resolved.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = resolved.repartition(parts, "path").sortWithinPartitions("path", "offset")
    return materialize(dealt.mapInArrow(per_partition, "path string, n_bytes long"), f"{uri}/manifest")


def deduplicate_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as archives, resolve revisits, write deduplicated archives; the records read back from those."""
    uri = work_uri(pages.sparkSession, "warc")
    first = write_archives(pages, f"{uri}/first")
    headers = materialize(read_records(first), f"{uri}/headers")
    second = write_deduplicated(resolve(headers, uri, least), f"{uri}/second")
    return read_records(second)

"""Token ids in sorted-string-table shards.

Documents are range-partitioned by id; each task tokenizes its range and streams it into shard files of one format:

    block*      zstd frame of: entry* restart* n_restarts, followed by a crc32 of the frame
                entry = varint shared key bytes, varint other key bytes, varint value bytes, key rest, value
                restart = u32 offset of an entry that shares nothing (every RESTART entries)
    index       per block: varint key bytes, last key, varint offset, varint bytes, varint entries, varint tokens
    Bloom       u32 number of hashes, then the bit array
    footer      FOOTER struct: places of index and Bloom filter, entries, tokens, id width, crc32 of both, magic

A lookup reads the footer, asks the Bloom filter, searches the sparse index by bisection, reads one block and bisects
its restarts. Values are little-endian ids of 2 bytes where the vocabulary allows it, else 4.

A shard counts only if the manifest lists it. The manifest is a table in the shared folder that Spark commits once per
task, so retried or lost tasks leave at most unlisted files.

Defined cases: a null text counts as empty and holds the end id alone; null ids come first; repeated ids are
neighbouring entries (``get`` returns all of a shard's); an empty table gives an empty manifest. Other columns are
ignored. Only one block, the index and 10 bits a key are in memory, not a shard.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty, work_uri

BLOCK_BYTES = 1 << 16
SHARD_BYTES = 1 << 28
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQBI8s")
MAGIC = b"TOKSST01"
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Streams sorted (key, ids) entries into one open file."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.entries = self.tokens = 0
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.last = bytearray(), [], b""
        self.block_entries = self.block_tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block_entries % RESTART:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.block_entries += 1
        self.block_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block_entries:
            return
        raw = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        frame = self.zstd.compress(raw)
        self.index.append((self.last, self.at, len(frame), self.block_entries, self.block_tokens))
        self.out.write(frame + struct.pack("<I", zlib.crc32(frame)))
        self.at += len(frame) + 4
        self.entries += self.block_entries
        self.tokens += self.block_tokens
        self._begin()

    def finish(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + b"".join(map(varint, rest)) for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = struct.pack("<IQ", BLOOM_HASHES, bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        at = self.at + len(index)
        self.out.write(FOOTER.pack(self.at, len(index), at, len(packed), self.entries, self.tokens, self.width, zlib.crc32(index + packed), MAGIC))
        self.at = at + len(packed) + FOOTER.size


class Reader:
    """Lookups and scans in one shard of a seekable file."""

    def __init__(self, source, size: int):
        self.source = source
        index_at, index_bytes, bloom_at, bloom_bytes, self.entries, self.tokens, self.width, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, bloom = self._read(index_at, index_bytes), self._read(bloom_at, bloom_bytes)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError("damaged index")
        self.bits = struct.unpack_from("<Q", bloom, 4)[0]
        self.bloom = bloom[12:]
        self.index, at = [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            key, at, numbers = index[at : at + n], at + n, []
            for _ in range(4):
                x, at = read_varint(index, at)
                numbers.append(x)
            self.index.append((key, *numbers))
        self.last_keys = [x[0] for x in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, np.ndarray]:
        import zstandard

        _, at, n, _, _ = self.index[k]
        frame = self._read(at, n + 4)
        if zlib.crc32(frame[:n]) != struct.unpack("<I", frame[n:])[0]:
            raise ValueError("damaged block")
        raw = zstandard.ZstdDecompressor().decompress(frame[:n])
        count = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * (count + 1)], np.frombuffer(raw[-4 * (count + 1) : -4], "<u4")

    @staticmethod
    def _entries(raw: bytes, at: int, last: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < len(raw):
            shared, at = read_varint(raw, at)
            other, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            last = last[:shared] + raw[at : at + other]
            at += other
            yield last, raw[at : at + n]
            at += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._entries(self._block(k)[0], 0)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key, without reading other keys' blocks."""
        key, found = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return found
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            raw, restarts = self._block(k)
            first = lambda at: next(self._entries(raw, int(at)))[0]
            place = max(0, bisect.bisect_left(restarts, key, key=first) - 1)
            for other, value in self._entries(raw, int(restarts[place])):
                if other == key:
                    found.append(self.ids(value))
                if other > key:
                    return found
        return found


class ChunkEncoder:
    """Encodes whole texts with a ``tokenizers`` tokenizer, remembering blank-free chunks.

    For tokenizers that drop white space and never merge across it, a text's ids are those of its chunks in turn; for
    those that also lower the case and part letters from marks, a chunk's are those of its lower-case word and of the
    marks behind it. Whether a tokenizer does both is tried out on a few strings. Two generations of remembered chunks
    bound the memory. Texts with separators U+001C to U+001F, where Python's split and the tokenizer differ, or with the
    mark of special tokens go to the library whole; those with letters beyond U+02AF, where case and composition have
    more rules, by chunks as they are.
    """

    KEEP = 600_000
    MARKS = ".,;:!?"
    SPECIAL = re.compile("[\x1c-\x1f]|<\\|")
    BEYOND = re.compile("[\u0130\u02b0-\U0010ffff]")
    BETWEEN = "|"
    ODD = re.compile(SPECIAL.pattern.replace("|<\\|", "|<") + "|" + BEYOND.pattern)
    TRIALS = ("The, quick.", "Élan; vital!! x", "don't stop, it's A.B?")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        parts = lambda text: [i for w in text.split() for i in whole(w)]
        self.by_chunk = all(parts(x) == whole(x) == parts(x.replace(" ", "\n ")) for x in self.TRIALS)
        split = lambda w: [x for x in (w.rstrip(self.MARKS).lower(), w[len(w.rstrip(self.MARKS)) :]) if x]
        self.by_word = self.by_chunk and all([i for x in split(w) for i in whole(x)] == whole(w) for x in self.TRIALS for w in x.split())
        mark = whole(self.BETWEEN)
        self.between = mark[0] if len(mark) == 1 and mark[0] not in {i for x in self.TRIALS for i in whole(x)} else None

    _made: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """The encoder of this worker process, with what it remembers from earlier tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _unknown(self, chunks: list[str]) -> None:
        """Remember chunks. They are encoded as one text with a mark of one id between them, and dealt out at its ids."""
        single = [c for c in chunks if self.between is None or self.BETWEEN in c]
        for c in single:
            self.new[c] = self._pack(self.tokenizer.encode(c, add_special_tokens=False).ids)
        joined = [c for c in chunks if c not in self.new]
        for at in range(0, len(joined), 500):
            part = joined[at : at + 500]
            text = f" {self.BETWEEN} ".join([*part, ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends, data, start = (np.flatnonzero(ids == self.between) * self.width).tolist(), ids.tobytes(), 0
            for c, end in zip(part, ends, strict=True):
                self.new[c] = data[start:end]
                start = end + self.width

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out, missing, get = [], (set(), set()), self.new.get
        for text in texts:
            plain = self.by_chunk and not self.ODD.search(text)
            if not plain and (not self.by_chunk or self.SPECIAL.search(text)):
                out.append(self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            simple = self.by_word and (plain or not self.BEYOND.search(text))
            chunks = text.lower().split() if simple else text.split()
            got = list(map(get, chunks))
            if None in got:
                missing[simple].update([c for c, x in zip(chunks, got, strict=True) if x is None])
                out.append(chunks)
            else:
                out.append(b"".join(got))
        for simple in (False, True):
            if missing[simple]:
                self._remember(missing[simple], simple)
        out = [x if isinstance(x, bytes) else b"".join(map(self.new.__getitem__, x)) for x in out]
        if len(self.new) > self.KEEP:
            self.old, self.new = self.new, {}
        return out

    def _remember(self, missing: set[str], simple: bool) -> None:
        new, old, parts, unknown = self.new, self.old, [], set()
        for c in missing:
            if c in old:
                new[c] = old[c]
                continue
            word = c.rstrip(self.MARKS) if simple else c
            if word != c and word and word[-1].isalpha():
                parts.append((c, word, c[len(word) :]))
                unknown.update(x for x in parts[-1][1:] if x not in new)
            else:
                unknown.add(c)
        for x in [x for x in unknown if x in old]:
            new[x] = old[x]
            unknown.discard(x)
        if unknown:
            self._unknown(sorted(unknown))
        for c, word, marks in parts:
            new[c] = new[word] + new[marks]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int = 1 << 19) -> Iterator[tuple[int | None, bytes]]:
    """(id, packed ids with the end id) of each (id, text) row, some texts at a time."""
    for batch in batches:
        ids, texts, total = [], [], 0
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
            ids.append(doc_id)
            texts.append(text.as_py())
            total += len(texts[-1])
            if total >= most or k == batch.num_rows:
                encoder = ChunkEncoder.of(tokenizer)
                end = np.array([end_id], encoder.kind).tobytes()
                yield from zip(ids, [x + end for x in encoder.encode_many(texts)], strict=True)
                ids, texts, total = [], [], 0


def _write(uri: str, tokenizer: str, end_id: int, shard_bytes: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, writer, out = TaskContext.get().partitionId(), [], None, None

        def close() -> None:
            writer.finish()
            out.close()
            rows.append((part, len(rows), name, writer.at, writer.entries, writer.tokens))

        for doc_id, value in encoded(batches, tokenizer, end_id):
            if writer is None:
                name = f"{uri}/shard-{part:06d}-{len(rows):04d}-{uuid4().hex}.sst"
                files, path = _open(name)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(path, compression=None)
                writer = Writer(out, ChunkEncoder.of(tokenizer).width)
            writer.add(key_of(doc_id), value)
            if writer.at >= shard_bytes:
                close()
                writer = None
        if writer is not None:
            close()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "seq", "path", "n_bytes", "n_docs", "n_tokens"])

    return per_partition


def write_shards(docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenize docs(doc_id, text) into shards in ascending id order; the manifest, with each shard's first place."""
    spark = docs.sparkSession
    uri = uri or work_uri(spark, "sstable")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ordered.mapInArrow(_write(uri, tokenizer, end_id, shard_bytes), "part long, seq long, path string, n_bytes long, n_docs long, n_tokens long")
    manifest = materialize(manifest, f"{uri}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(ids, starts, counts, crcs):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for name, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            files, path = _open(name)
            out: list[tuple] = []
            with files.open_input_file(path) as source:
                reader = Reader(source, size)
                for key, value in reader.scan():
                    ids = reader.ids(value)
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 8192:
                        yield rows_of(*zip(*out, strict=True))
                        out = []
            if out:
                yield rows_of(*zip(*out, strict=True))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the shards."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "n_bytes", "start").repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

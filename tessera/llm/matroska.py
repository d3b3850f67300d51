"""Media columns: a Matroska writer for 8-bit PCM and a parser of EBML elements into packet tables.

``with_media`` adds a binary column with a Matroska file per row; ``packets`` turns such a column into one row per
frame with track, timestamp, byte range and cue flag; ``payloads`` reads each row's frames back by those byte ranges.
The parser handles variable-length ids and sizes, elements of unknown size, SimpleBlock and BlockGroup, all four kinds
of lacing (none, Xiph, fixed, EBML) and Cues.

Defined cases: a null text counts as empty, and still gives one frame of padding; equal texts give equal media; rows
are handled one by one, so repeated rows, ties and null ids stay as they are; an empty table gives an empty result;
other columns are ignored. Memory holds one row's text and media at a time, besides Arrow's batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

FRAME = 576
PAD = b"\xff"
SAMPLE_RATE = 48_000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32
TIMESTAMP_SCALE = 1_000_000

# Fixed values of the Matroska specification: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")


def size_vint(n: int, width: int = 0) -> bytes:
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return size_vint(n + (1 << 7 * width - 1) - 1, width)


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + size_vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The flag bits and the body of a block with these frames."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    elif lacing == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing takes frames of one size")
    else:
        raise ValueError(f"no lacing can't hold {len(frames)} frames")
    return LACINGS.index(lacing) << 1, head + b"".join(frames)


def mux(payload: bytes, lacing: str = "fixed", frame: int = FRAME) -> bytes:
    """A Matroska file of one 8-bit mono PCM track that holds payload."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    per_block = 1 if lacing == "none" else FRAMES_PER_BLOCK
    blocks = [frames[i : i + per_block] for i in range(0, len(frames), per_block)]
    ms = lambda k: k * frame * 1000 // SAMPLE_RATE
    text = lambda kind, s: element(kind, s.encode())
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + text(DOC_TYPE, "matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    duration = len(payload) * 1000 / SAMPLE_RATE
    parts = [element(INFO, number(SCALE, TIMESTAMP_SCALE) + element(DURATION, struct.pack(">d", duration)) + text(MUXING_APP, "tessera") + text(WRITING_APP, "tessera"))]
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    parts.append(element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, int(per_block > 1)) + number(DEFAULT_DURATION, frame * 1_000_000_000 // SAMPLE_RATE) + text(CODEC_ID, "A_PCM/INT/LIT") + audio)))
    place, cues = sum(map(len, parts)), []
    for c in range(0, len(blocks), BLOCKS_PER_CLUSTER):
        base = ms(c * per_block)
        body = [number(TIMESTAMP, base)]
        for k, block in enumerate(blocks[c : c + BLOCKS_PER_CLUSTER], c):
            flags, data = laced(block, lacing)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ms(k * per_block) - base, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        place += len(cluster)
        parts.append(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length number and the place behind it; -1 for the reserved unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"damaged variable-length number at {at}")
    width = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n ^= 1 << 7 * width
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start of body, end of body) in document order; bodies of masters are walked into."""
    ends = [end]  # of the masters that ``at`` is in
    while at < end:
        while ends[-1] <= at:
            ends.pop()
        kind, body = read_vint(data, at, keep_marker=True)
        n, body = read_vint(data, body)
        stop = ends[-1] if n < 0 else body + n
        if stop > ends[-1]:
            raise ValueError(f"element {kind:#x} at {at} ends beyond its parent")
        yield kind, at, body, stop
        if kind in MASTERS:
            ends.append(stop)
        at = body if kind in MASTERS else stop


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose lacing header begins at ``at``."""
    if lacing == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3 and n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = read_vint(data, at)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    elif lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return [*out, (at, end - at)]


def demux(data: bytes) -> list[tuple[int, int, int, int, str, bool, bool]]:
    """(track, timestamp in ns, offset, size, lacing, key frame, block's cluster has a cue) of every frame, in order."""
    scale, now, segment, cluster = TIMESTAMP_SCALE, 0, 0, 0
    durations: dict[int, int] = {}
    track, rows, cued = 0, [], set()
    for kind, place, at, end in elements(data, 0, len(data)):
        if kind == SEGMENT:
            segment = at
        elif kind == SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif kind == TRACK_NUMBER:
            track = int.from_bytes(data[at:end], "big")
        elif kind == DEFAULT_DURATION:
            durations[track] = int.from_bytes(data[at:end], "big")
        elif kind == CLUSTER:
            cluster = place - segment
        elif kind == TIMESTAMP:
            now = int.from_bytes(data[at:end], "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            number_, at = read_vint(data, at)
            offset, flags = struct.unpack_from(">hB", data, at)
            lacing = flags >> 1 & 3
            for k, (start, n) in enumerate(frame_ranges(data, at + 3, end, lacing)):
                rows.append((number_, (now + offset) * scale + k * durations.get(number_, 0), start, n, LACINGS[lacing], bool(flags & 0x80) or kind == BLOCK, cluster))
        elif kind == CUE_CLUSTER:
            cued.add(int.from_bytes(data[at:end], "big"))
    return [(*row[:6], row[6] in cued) for row in rows]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + PAD * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: int = -1, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 64 + (len(row[weight]) if weight >= 0 else 0)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def with_media(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """(doc_id, n_bytes, media) per row of docs(doc_id, text)."""

    def per_partition(batches):
        yield from _batched(((i, n, mux(payload, lacing)) for i, (n, payload) in ((i, padded(text)) for i, text in _rows(batches))), MEDIA, 2)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(per_partition, "doc_id long, n_bytes long, media binary")


PACKETS = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("lacing", pa.string()), ("key", pa.bool_()), ("cued", pa.bool_())])


def packets(media: DataFrame) -> DataFrame:
    """The packet table of media(doc_id, media)."""

    def per_partition(batches):
        yield from _batched(((i, k, *row) for i, data in _rows(batches) for k, row in enumerate(demux(data or b""))), PACKETS)

    return media.select("doc_id", "media").mapInArrow(per_partition, "doc_id long, packet long, track long, timestamp_ns long, offset long, size long, lacing string, key boolean, cued boolean")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(doc_id: int | None, n_bytes: int, data: bytes) -> tuple:
    table = demux(data)
    payload = b"".join([data[at : at + n] for _, _, at, n, _, _, _ in table])
    last = table[-1]
    feature = f"tracks={len({x[0] for x in table})};packets={len(table)};cued={sum(x[6] for x in table)};last_ns={last[1]};first_at={table[0][2]};last_at={last[2]};lacing={last[4]}"
    return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def payload_digests(media: DataFrame) -> DataFrame:
    """Digests of each row's payload, read back from the stored bytes by the packet table's byte ranges."""

    def per_partition(batches):
        yield from _batched((_digest(*row) for row in _rows(batches)), DIGESTS)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(per_partition, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

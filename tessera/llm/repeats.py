"""Suffix-array dedup: what is covered by a long string that also starts elsewhere, by column-wise construction.

The Burrows-Wheeler transform and the common prefixes of a collection are built column by column: each round inserts
one symbol of every document in front of what is there, re-sorts by it stably, and updates the common prefixes of
neighbours. Where neighbours agree on ``length`` symbols, the strings that start there repeat. The result is read from
the order and the common prefixes; the transform, which a round also gives, is what the next round inserts.

Symbols are of two kinds, and each has its own run of the same construction:

* bytes: strings of LENGTH bytes that start anywhere else, same document included; these are removed.
* words (``WORD_BYTES`` bytes of a hash each): passages of PASSAGE_WORDS words or more that another document also holds;
  these are counted, not removed, and find what is shorter than LENGTH bytes.

To run that at scale, documents are first cut to what can repeat, and aligned:

* Each window of ``length`` symbols has an anchor: its leftmost substring of ``gram`` symbols with the least hash. Equal
  windows have equal anchors at equal places, so only windows of one anchor can be equal, and only in the same column
  when their texts are aligned at the anchor. Suffixes of different columns need no common order, and a round costs the
  number of documents rather than the number of symbols inserted so far.
* An anchor whose gram occurs once in the corpus is dropped after one aggregate of hashes; no text is moved for it.
* For the rest, the stretch that its windows cover goes to the anchor's group. Groups are batched; a batch is written
  as a file of columns, which the rounds read in sequence from the last to the first. State is one order and one
  array of common prefixes, in memory.
* An anchor with more than ``most`` stretches does not go to one task. Its windows are split into narrower runs, each
  under the hash of the symbols that all windows of the run share; runs whose hash occurs once are dropped, and what is
  still too large is split further, down to single windows, where the hash is the whole string's.

Exact copies of a whole text are one text here, with a number of copies. Three things are decided by 128-bit hashes and
not by comparison: that whole texts are equal (md5), that a text holds the same stretch twice (xxh3), and that single
windows of oversized groups are equal (xxh3). Words are told apart by 32-bit hashes; two passages would have to differ
in nothing but words whose hashes collide to be taken for equal. All else is compared symbol by symbol.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; a text that occurs twice loses all;
overlapping occurrences in one text count; repeated rows and null ids are rows of their own, each a copy of the other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skew_join, text_or_empty, work_uri

LENGTH = 400
GRAM = 200
MOST = 1024
#: Windows of a run, from level to level, for oversized groups.
WIDTHS = (25, 5, 1)
#: Stretches of one batch of the column-wise construction.
BATCH = 1 << 14
PIECE = 1 << 19
#: A passage is of more than 50 words.
PASSAGE_WORDS = 51
PASSAGE_GRAM = 26
WORD_BYTES = 4
BASE = 6364136223846793005


@dataclass(frozen=True)
class Symbols:
    """What a text is a sequence of, and when strings of it repeat.

    ``across``: only strings that another text holds too count, and not those that one text holds twice.
    """

    length: int = LENGTH
    gram: int = GRAM
    words: bool = False

    @property
    def across(self) -> bool:
        return self.words

    @property
    def width(self) -> int:
        return WORD_BYTES if self.words else 1

    @property
    def kind(self) -> type:
        return np.uint32 if self.words else np.uint8

    def encode(self, text: str, powers: Powers) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        return word_codes(raw, powers) if self.words else raw


PASSAGES = Symbols(PASSAGE_WORDS, PASSAGE_GRAM, True)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Powers:
    """BASE ** i and its inverse modulo 2 ** 64."""

    def __init__(self) -> None:
        up, down = np.full(PIECE + LENGTH, BASE, np.uint64), np.full(PIECE + LENGTH, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_codes(raw: bytes, powers: Powers) -> bytes:
    """WORD_BYTES bytes for each word of a text: the upper half of a polynomial over the word's bytes, mixed."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.r_[True, BLANK[data], True]
    starts, stops = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    out, at = [], 0
    while at < len(starts):  # whole words of about PIECE bytes
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, "right")))
        lengths = stops[at:upto] - starts[at:upto]
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        letters = data[starts[at] : stops[upto - 1]]
        letters = letters[~BLANK[letters]]
        place = (np.arange(len(letters)) - np.repeat(first, lengths)) % PIECE
        h = np.add.reduceat((letters + np.uint64(1)) * powers.up[place], first)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(32)).astype(np.uint32))
        at = upto
    return np.concatenate(out).tobytes() if out else b""


def gram_hashes(raw: np.ndarray, powers: Powers, gram: int) -> np.ndarray:
    """A hash of each substring of ``gram`` bytes, from one running sum."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * powers.up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, powers: Powers, length: int, gram: int, kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first window, last window) of each anchor of a text, in order."""
    low = np.uint64((1 << 20) - 1)
    out = []
    symbols = np.frombuffer(data, kind)
    for at in range(0, max(0, len(symbols) - length + 1), PIECE):
        raw = symbols[at : at + PIECE + length - 1]
        h = gram_hashes(raw, powers, gram)
        places = sliding_least(h & ~low | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        last = np.r_[first[1:], len(places)] - 1
        place = places[first].astype(np.int64)
        out.append((h[place], place + at, first + at, last + at))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(of: Symbols):
    """(key, text, times) per distinct anchor key and distinct text of a task.

    With ``across``, a row without key says how many symbols a text has, if they are enough for a window.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            keys, owners, times = [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                data = of.encode(text.as_py(), powers)
                if len(data) < of.length * of.width:
                    continue
                found, n = np.unique(anchors(data, powers, of.length, of.gram, of.kind)[0], return_counts=True)
                keys.append(pa.array(found.view(np.int64)))
                times.append(n)
                owners += [digest] * len(found)
                if of.across:
                    keys.append(pa.nulls(1, pa.int64()))
                    times.append([len(data) // of.width])
                    owners.append(digest)
            if owners:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(owners, pa.binary()), pa.array(np.concatenate(times).astype(np.int64))], names=["key", "text", "times"])

    return per_partition


def _packed(of: Symbols):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, powers, seen = zstandard.ZstdCompressor(level=1), Powers(), set()
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, squeeze.compress(of.encode(text.as_py(), powers))))
            if rows:
                digests, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["text", "packed"])

    return per_partition


#: A stretch: the text, its first symbol's place there, the place of the anchor from there, and its number of windows.
STRETCH = "key binary, text binary, start long, anchor int, windows int, stretch binary, hot boolean"
STRETCH_ARROW = pa.schema([("key", pa.binary()), ("text", pa.binary()), ("start", pa.int64()), ("anchor", pa.int32()), ("windows", pa.int32()), ("stretch", pa.binary()), ("hot", pa.bool_())])


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def runs_of(start: int, anchor: int, windows: int, stretch: bytes, of: Symbols, width: int) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """A stretch's windows in runs of ``width``, aligned at the anchor, under the hash of the symbols common to a full run."""
    import xxhash

    w = of.width
    for block in range(-anchor // width, (windows - 1 - anchor) // width + 1):
        low, high = block * width + anchor, block * width + width - 1 + anchor  # the windows of a full run, in the stretch
        first, last = max(low, 0), min(high, windows - 1)
        key = xxhash.xxh3_128_digest(stretch[high * w : max(high, low + of.length) * w], seed=block & 0xFFFF)
        yield key, start + first, anchor - first, last - first + 1, stretch[first * w : (last + of.length) * w]


def _stretches(of: Symbols):
    """Stretches of the candidate anchors; those that a text holds twice are sent once.

    A row without key says so: the text, the place, in ``anchor`` the place of the one sent, and the number of windows.
    """
    length, w = of.length, of.width

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import xxhash
        import zstandard

        unpack, powers = zstandard.ZstdDecompressor(), Powers()
        for batch in batches:
            for digest, packed, cold, hot in zip(*batch.columns, strict=True):
                digest, data = digest.as_py(), unpack.decompress(packed.as_py())
                hot = set(hot.as_py())
                wanted = np.array(sorted(hot.union(cold.as_py())), np.int64)
                keys, places, firsts, lasts = anchors(data, powers, length, of.gram, of.kind)
                keys = keys.view(np.int64)
                sent: dict[bytes, int] = {}
                for k in np.flatnonzero(np.isin(keys, wanted)).tolist():
                    first, anchor, n = int(firsts[k]), int(places[k] - firsts[k]), int(lasts[k] - firsts[k]) + 1
                    stretch = data[first * w : (first + n + length - 1) * w]
                    known = sent.setdefault(xxhash.xxh3_128_digest(stretch, seed=anchor), first)
                    if known != first:
                        yield None, digest, first, known, n, None, False
                        continue
                    key = int(keys[k])
                    if key not in hot:
                        yield key.to_bytes(8, "big", signed=True), digest, first, anchor, n, stretch, False
                        continue
                    for run in runs_of(first, anchor, n, stretch, of, WIDTHS[0]):
                        yield run[0], digest, *run[1:], True

    return lambda batches: _batched(rows(batches), STRETCH_ARROW)


def _narrower(width: int, of: Symbols):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                for run in runs_of(row["start"], row["anchor"], row["windows"], row["stretch"], of, width):
                    yield run[0], row["text"], *run[1:], True

    return lambda batches: _batched(rows(batches), STRETCH_ARROW)


def insert_columns(groups: np.ndarray, anchors_at: np.ndarray, stretches: list[bytes], of: Symbols) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of the construction: (column, order, transform, common prefixes), columns counted from the anchor.

    ``groups`` is sorted. After a column's round, ``order`` lists the stretches by group and by their text from this
    column on, and common[i] is the number of symbols on which order[i - 1] and order[i] agree (0 between groups). The
    transform is the symbol in front of each, which the next round inserts; -1 where a stretch has none. Words go by
    their rank among the words of all these stretches.
    """
    m, left = len(stretches), of.length - of.gram
    begin = left - anchors_at  # the column of a stretch's first symbol, columns counted from ``left`` before the anchor
    end = begin + np.array([len(x) // of.width for x in stretches])
    width, alphabet = left + of.length, np.unique(np.frombuffer(b"".join(stretches), np.uint32)) if of.words else None
    many = 2 + (256 if alphabet is None else len(alphabet))
    with tempfile.TemporaryFile() as file:
        for at in range(0, m, 1024):  # the rows of some stretches, then all of them as columns
            block = np.zeros((min(1024, m - at), width), of.kind)
            for i, x in enumerate(stretches[at : at + 1024]):
                row = np.frombuffer(x, of.kind)
                block[i, begin[at + i] : end[at + i]] = row if alphabet is None else np.searchsorted(alphabet, row)
            columns = np.ascontiguousarray(block.T)
            for c in range(width):
                file.seek((c * m + at) * of.width)
                file.write(columns[c].data)

        def symbols(column: int) -> np.ndarray:
            file.seek(column * m * of.width)
            found = np.frombuffer(file.read(m * of.width), of.kind).astype(np.int64)
            return np.where((begin <= column) & (column < end), found, -1)

        order, common = np.arange(m), np.zeros(m + 1, np.int64)
        transform = symbols(width - 1)
        for column in range(width - 1, -1, -1):
            key = groups[order] * many + transform + 1
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % many > 0)) + 1
            fresh = np.zeros(m + 1, np.int64)
            if len(same):
                between = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
                fresh[same] = np.minimum.reduceat(common, between)[::2] + 1
            order, common = order[moved], fresh
            transform = symbols(column - 1)[order] if column else np.full(m, -1)
            yield column - left, order, transform, common


def repeated_windows(groups: np.ndarray, anchors_at: np.ndarray, windows: np.ndarray, stretches: list[bytes], of: Symbols, owners: np.ndarray) -> np.ndarray:
    """For each stretch and window place (from ``length - gram`` before the anchor), whether the window repeats.

    With ``across``, equal windows must have different owners.
    """
    left = of.length - of.gram
    found = np.zeros((len(stretches), left + 1), bool)
    for column, order, _, common in insert_columns(groups, anchors_at, stretches, of):
        if column <= 0:
            long = common >= of.length
            repeats = long[:-1] | long[1:]
            if of.across:  # runs of equal windows
                start = np.flatnonzero(~long[:-1])
                mixed = np.minimum.reduceat(owners[order], start) < np.maximum.reduceat(owners[order], start)
                repeats = np.repeat(mixed, np.diff(np.r_[start, len(order)]))
            found[order, column + left] = repeats
    place = np.arange(left + 1)[None, :] - (left - anchors_at)[:, None]
    return found & (place >= 0) & (place < windows[:, None])


INTERVAL = pa.schema([("text", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])


def _construct(of: Symbols):
    """Intervals of repeated symbols, from stretches that come sorted by key."""

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        keys, texts, starts, at, windows, stretches, _ = zip(*rows, strict=True)
        groups = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
        at, windows, left = np.array(at, np.int64), np.array(windows, np.int64), of.length - of.gram
        numbers: dict[bytes, int] = {}
        owners = np.array([numbers.setdefault(x, len(numbers)) for x in texts])
        found = np.pad(repeated_windows(groups, at, windows, list(stretches), of, owners), ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(found, axis=1)
        who, first = np.nonzero(change == 1)
        _, last = np.nonzero(change == -1)
        for i, a, b in zip(who.tolist(), first.tolist(), last.tolist(), strict=True):
            shift = starts[i] + int(at[i]) - left
            yield texts[i], shift + a, shift + b + of.length - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from solved(held)
                    held = []
                held.append(row)
        if held:
            yield from solved(held)

    return lambda batches: _batched(rows(batches), INTERVAL)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    schema = pa.schema([("text", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def rows():
        for batch in batches:
            for digest, packed, spans in zip(*batch.columns, strict=True):
                data, at, kept = unpack.decompress(packed.as_py()), 0, hashlib.sha256()
                spans = merged([(x["start"], x["stop"]) for x in spans.as_py()])
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                yield digest.as_py(), sum(b - a for a, b in spans), len(spans), kept.hexdigest()

    yield from _batched(rows(), schema)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of a text in intervals, at the places of stretches sent and of those that are the same."""

    def rows():
        for batch in batches:
            for text, spans, again in zip(*batch.columns, strict=True):
                own = merged([(x["start"], x["stop"]) for x in spans.as_py()])
                stops, out = [b for _, b in own], list(own)
                for x in again.as_py() or []:
                    a, b = x["anchor"], x["anchor"] + x["symbols"]
                    for lo, hi in own[bisect.bisect_right(stops, a) :]:
                        if lo >= b:
                            break
                        out.append((max(lo, a) - a + x["start"], min(hi, b) - a + x["start"]))
                yield text.as_py(), sum(b - a for a, b in merged(out))

    yield from _batched(rows(), pa.schema([("text", pa.binary()), ("n", pa.int64())]))


def _split_hot(stretches: DataFrame, uri: str, of: Symbols, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches of oversized groups as groups that are small enough, and the repeats known from single windows."""
    groups, known = [], []
    for level, width in enumerate(WIDTHS):
        if level:
            stretches = materialize(stretches.mapInArrow(_narrower(width, of), STRETCH), f"{uri}/hot-{width}")
        counts = stretches.groupBy("key").agg(F.count("*").alias("n"), (F.min("text") < F.max("text")).alias("mixed"))
        counts = materialize(counts.withColumn("size", F.col("n")), f"{uri}/hot-{width}-counts")
        sized = skew_join(stretches, counts, "key", "n", ["text", "start"]).where("mixed" if of.across else "size >= 2").drop("mixed")
        if width == 1:
            known.append(sized.select("text", "start", "windows"))
            break
        groups.append(sized.where(F.col("size") <= most).drop("size"))
        stretches = sized.where(F.col("size") > most).drop("size")
        if stretches.isEmpty():
            break
    return groups, known


@dataclass(frozen=True)
class Found:
    """(text, start, stop) of repeated symbols, overlapping ones too; the stretches that are the same as another of their
    text (text, start, anchor: the other's place, symbols); the packed texts that may have some; the keys of all.
    """

    spans: DataFrame
    again: DataFrame
    packed: DataFrame
    keyed: DataFrame


def intervals(texts: DataFrame, uri: str, of: Symbols = Symbols(), most: int = MOST) -> Found:
    """texts has the columns text (a digest) and body; rows of one digest count as one."""
    body = texts.where(F.octet_length("body") >= (of.length * 2 - 1 if of.words else of.length))
    keyed = materialize(body.mapInArrow(_keys(of), "key long, text binary, times long"), f"{uri}/keys")
    sums = keyed.where("key is not null").groupBy("key").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"), F.max("times").alias("times"), F.sum("times").alias("total"), F.count("*").alias("n"))
    twice = materialize(sums.where("a <> b" if of.across else "a <> b or times > 1").select("key", "n", (F.col("total") > most).alias("hot")), f"{uri}/twice")
    wanted = skew_join(keyed.where("key is not null"), twice, "key", "n", ["text"]).where("hot is not null")
    pick = lambda hot: F.collect_set(F.when(F.col("hot") == hot, F.col("key")))
    wanted = wanted.groupBy("text").agg(pick(False).alias("cold_keys"), pick(True).alias("hot_keys"))
    packed = body.mapInArrow(_packed(of), "text binary, packed binary").groupBy("text").agg(F.first("packed").alias("packed"))
    cut = materialize(packed.join(wanted, "text"), f"{uri}/candidates")
    stretches = materialize(cut.mapInArrow(_stretches(of), STRETCH), f"{uri}/stretches")
    plain = stretches.where("key is not null")
    hot = plain.where("hot")
    groups, known = _split_hot(hot, uri, of, most) if not hot.isEmpty() else ([], [])
    ready = plain.where("not hot")
    for more in groups:
        ready = ready.unionByName(more)
    found = ready.repartition("key").sortWithinPartitions("key").mapInArrow(_construct(of), "text binary, start long, stop long")
    symbols = F.col("windows") + F.lit(of.length - 1).cast("long")
    again = stretches.where("key is null").select("text", "start", F.col("anchor").cast("long").alias("anchor"), symbols.alias("symbols"))
    for repeat in known:
        found = found.unionByName(repeat.select("text", "start", (F.col("start") + symbols).alias("stop")))
    if not of.across:  # both places repeat
        for place in ("start", "anchor"):
            found = found.unionByName(again.select("text", F.col(place).alias("start"), (F.col(place) + F.col("symbols")).alias("stop")))
    return Found(found, again, cut.select("text", "packed"), keyed)


def shared_words(texts: DataFrame, uri: str, of: Symbols = PASSAGES, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(text, n): the words in passages that another text holds too; (text, n): the words of texts that have a passage."""
    found = intervals(texts, uri, of, most)
    spans = found.spans.groupBy("text").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    again = found.again.groupBy("text").agg(F.collect_list(F.struct("start", "anchor", "symbols")).alias("again"))
    shared = spans.join(again, "text", "left").mapInArrow(_count_shared, "text binary, n long")
    return shared, found.keyed.where("key is null").groupBy("text").agg(F.max("times").alias("n"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, passage: Symbols = PASSAGES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words) for each row of docs(doc_id, text).

    n_shared_words counts the words, as written and parted by ASCII white space, in passages of ``passage.length`` words
    or more that another row holds too; all words of a text that long that occurs twice.
    """
    uri = work_uri(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")).withColumn("text", F.unhex(F.md5(F.col("body").cast("binary"))))
    small = materialize(rows.select("doc_id", "text", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("whole")), f"{uri}/rows")
    found = intervals(rows.select("text", "body"), uri, Symbols(length, gram), most)
    spans = found.spans.groupBy("text").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kept = found.packed.join(spans, "text").mapInArrow(_kept, "text binary, n_removed long, n_spans long, kept_sha256 string")
    shared, all_words = shared_words(rows.select("text", "body"), f"{uri}/words", passage, most)
    copies = small.groupBy("text").agg(F.count("*").alias("n"))
    known = copies.join(kept, "text", "left").join(shared.withColumnRenamed("n", "shared"), "text", "left").join(all_words.withColumnRenamed("n", "words"), "text", "left")
    known = materialize(known.withColumn("copies", F.col("n")), f"{uri}/known")
    joined = skew_join(small, known, "text", "n", ["doc_id"])
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda all_of_it, some, none: F.when(whole, all_of_it).otherwise(F.coalesce(some, none))
    return joined.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"),
        F.coalesce(F.when(F.col("copies") > 1, F.col("words")), F.col("shared"), F.lit(0).cast("long")).alias("n_shared_words"),
    )

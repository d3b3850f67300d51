"""Near copies for a corpus: SimHash fingerprints met at the points of a covering code, five-word Jaccard similarity decides.

Words are those of ``simhash``; features are the hashes of the *distinct* five-word shingles, and a fingerprint has 1,024
bits. ``simhash``'s code of length 63 meets fingerprints at two differing bits; texts at a similarity of 0.8 differ in
155. So the bits are dealt, in ROUNDS orders, into segments of LENGTH = 64, and a segment's anchor is the nearest word
of the first-order Reed-Muller code of that length: 128 words, covering radius 28. A bit counts by how clear its
majority was (soft decision). KEY_SEGMENTS anchors make a key of 28 bits; a text is replicated to the keys with the
nearest or second nearest word in the two least certain segments, 4 rows for each of TABLES keys. At a similarity of 0.8
two texts meet at a key with probability 0.216, so 1 - (1 - 0.216) ** TABLES = 0.9996 of the pairs meet. In a bucket,
texts are candidates where their fingerprints differ in at most RADIUS bits and their numbers of shingles allow a
similarity of LEAST. Every candidate is verified on its texts; texts are linked at LEAST or more.

Large families do not make all their pairs. First each text is verified against the one that it shares most tables with,
of those before it and the first in its buckets. In buckets with texts that are still apart, each text outside the
bucket's commonest component asks that component. A text goes once to each component that it asks, however many buckets
it shares with it, and there it is verified against the nearest of the members that it shares a bucket with. Last, with
the components that this leaves, all candidates of a text in the components that it asks are verified, and those between
two texts that are both outside the commonest component meet in their buckets; one link is kept for each two components
that join. That leaves out no link between components, and the members of a large component are not replicated to their
keys. Equal word sequences count once. A bucket is held by one task, as numbers of rows, and as fingerprints, at the end
with the texts that are still open, of what is outside its commonest component. Members and askers of a component are
dealt over up to GRID x GRID tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cleaned, materialize, skew_join, text_or_empty, work_uri
from tessera.llm.graph import connected_components
from tessera.llm.simhash import HASH_SEED

SHINGLE_WORDS = 5
LEAST = 0.8
BITS = 1024
WORDS64 = BITS // 64
LENGTH = 64
KEY_SEGMENTS = 4
ROUNDS = 8
TABLES = ROUNDS * BITS // (LENGTH * KEY_SEGMENTS)
#: Bits of the fingerprint that travel with a key, and in how many of them a candidate may differ: 0.999 of the pairs at
#: similarity 0.8 pass, a tenth of the others.
SLICE = 30
SLICE_RADIUS = 11
#: Of BITS; two texts at similarity 0.8 differ in 155 on average, with a deviation of 11.5.
RADIUS = 205
#: Texts before it in a bucket that the first pass compares a text with, besides the bucket's first.
NEIGHBOURS = 16
BLOCK = 1 << 20
#: Rows of a few longs that are broadcast (some 80 MB for one); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Texts that one task verifies against the same other.
STAR = 1000
#: Members of a component, or texts that ask it, that one task compares, up to GRID times as many; then tasks hold more.
CELL = 256
GRID = 32

_LANES = np.uint64(0x0101010101010101)
_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, (WORDS64, 1), np.uint64)
_ORDERS = [np.random.default_rng([6, r]).permutation(BITS) for r in range(ROUNDS)]
_HADAMARD = reduce(lambda h, _: np.block([[h, h], [h, -h]]), range(LENGTH.bit_length() - 1), np.ones((1, 1), np.float32))


def shingle_set(text: str) -> tuple[bytes, np.ndarray]:
    """The words joined by blanks, and the sorted hashes of the distinct shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if not words:
        return line, np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(SHINGLE_WORDS, len(words))
    starts, stops = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return line, np.unique(np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def _tally(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles have each of the BITS bits; and the least shingle in WORDS64 orders."""
    least = np.full(WORDS64, np.iinfo(np.uint64).max)
    ones = np.zeros((WORDS64, 8, 8), np.int64)  # word, bit of the byte, byte
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        x = (part[None, :] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        least = np.minimum(least, x.min(axis=1))
        rows = -(-len(part) // 255)  # a byte counts up to 255
        held = np.zeros((WORDS64, rows * 255), np.uint64)
        held[:, : len(part)] = x
        held = held.reshape(WORDS64, rows, 255)
        for bit in range(8):
            lanes = ((held >> np.uint64(bit)) & _LANES).sum(axis=2, dtype=np.uint64)
            ones[:, bit] += lanes.view(np.uint8).reshape(WORDS64, rows, 8).sum(axis=1, dtype=np.int64)
    return ones.reshape(-1), least


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits((2 * ones > n).reshape(WORDS64, 64), axis=1).view(np.uint64).ravel()


def long_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WORDS64 words of 64 bits, bit by bit the majority over the shingles; and the least shingle in WORDS64 orders."""
    ones, least = _tally(hashes)
    return _majority(ones, len(hashes)), least


def anchors(margins: np.ndarray) -> np.ndarray:
    """For each row of BITS margins: the nearest code word of every segment, the second nearest, and, for each key, which
    two of its segments are the least certain; as bytes.
    """
    n, out = len(margins), ([], [], [])
    for order in _ORDERS:
        to = margins[:, order].reshape(n, -1, LENGTH) @ _HADAMARD  # how far each segment agrees with each word
        found = []
        size = np.abs(to)
        for _ in range(2):
            at = size.argmax(axis=2)[..., None]
            found.append((2 * at + (np.take_along_axis(to, at, 2) < 0), np.take_along_axis(size, at, 2)[..., 0]))
            np.put_along_axis(size, at, -1, 2)
        gap = (found[0][1] - found[1][1]).reshape(n, -1, KEY_SEGMENTS).argsort(axis=2, kind="stable")
        for held, x in zip(out, (found[0][0][..., 0], found[1][0][..., 0], gap[..., 0] * KEY_SEGMENTS + gap[..., 1]), strict=True):
            held.append(x.astype(np.uint8))
    return np.concatenate([np.concatenate(x, axis=1) for x in out], axis=1)


def keys_of(codes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The 4 keys in each table for rows of ``anchors``: table, code words, and SLICE bits of the fingerprint."""
    n, width = len(codes), TABLES * KEY_SEGMENTS
    words = np.stack([codes[:, :width], codes[:, width : 2 * width]]).astype(np.int64).reshape(2, n, TABLES, KEY_SEGMENTS)
    shift = 7 * np.arange(KEY_SEGMENTS)
    least = words[0] << shift
    change = (words[1] << shift) - least
    key = least.sum(axis=2) + (np.arange(TABLES) << (7 * KEY_SEGMENTS))
    unsure = codes[:, 2 * width :].astype(np.int64)
    one, two = (np.take_along_axis(change, x[..., None], 2)[..., 0] for x in (unsure // KEY_SEGMENTS, unsure % KEY_SEGMENTS))
    part = prints.view(np.uint32)[:, :TABLES].astype(np.int64) & ((1 << SLICE) - 1)
    return np.stack([(key + x << SLICE) | part for x in (0, one, two, one + two)], axis=2).reshape(n, -1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets as sorted arrays; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            content, size, prints, margins = [], [], [], []
            for text in batch.column(2):
                line, hashes = shingle_set(text.as_py())
                ones, _ = _tally(hashes)
                content.append(xxhash.xxh3_128_digest(line))
                size.append(len(hashes))
                prints.append(_majority(ones, len(hashes)).tobytes())
                margins.append(2 * ones - len(hashes))
            codes = [x.tobytes() for x in anchors(np.array(margins, np.float32))]
            columns = [batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "id", "content", "size", "print", "codes"])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of (node, print, codes)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            codes, prints = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 1))
            keys = keys_of(codes, prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that come by bucket, the first with keys, cut between buckets."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
        bucket = columns[0] >> SLICE
        last = int(np.searchsorted(bucket, bucket[-1]))  # the bucket that may go on in the next batch
        if held and (last or bucket[0] != held[-1][0][-1] >> SLICE):
            same = max(last, int(np.searchsorted(bucket, held[-1][0][-1] >> SLICE, "right")))
            held.append([c[:same] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, columns = [], [c[same:] for c in columns]
        elif last:
            yield [c[:last] for c in columns]
            columns = [c[last:] for c in columns]
        if len(columns[0]):
            held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, first, before) of rows in buckets of two or more: the bucket's first node and the one before, -1 where their slices are too far."""
    for key, node in _whole_buckets(batches):
        bucket, part, every = key >> SLICE, key & ((1 << SLICE) - 1), np.arange(len(key))
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        at = np.flatnonzero(new)
        n = np.repeat(np.diff(np.r_[at, len(key)]), np.diff(np.r_[at, len(key)]))
        start, before = np.maximum.accumulate(np.where(new, every, 0)), np.maximum(every - 1, 0)
        near = lambda j: ~new & (np.bitwise_count(part ^ part[j]) <= SLICE_RADIUS)  # noqa: E731, B023
        first, last = near(start), near(before)
        keep = (n > 2) | (n == 2) & (first | np.r_[first[1:] & ~new[1:], False])
        last &= before != start
        columns = (key, node, np.where(first, node[start], -1), np.where(last, node[before], -1))
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["key", "node", "first", "before"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, node), key without its slice, of rows whose slice is near to one with another label in their bucket."""
    for key, label, node in _whole_buckets(batches):
        bucket, part = key >> SLICE, key & ((1 << SLICE) - 1)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        mixed = np.minimum.reduceat(label, cuts) != np.maximum.reduceat(label, cuts)
        found = np.zeros(len(key), bool)
        for a, b in zip(cuts[mixed].tolist(), np.r_[cuts[1:], len(key)][mixed].tolist(), strict=True):
            names, numbers, counts = np.unique(label[a:b], return_inverse=True, return_counts=True)
            rows, step = np.flatnonzero(numbers != counts.argmax()), max(1, BLOCK // (b - a))
            for k in range(0, len(rows), step):
                i = rows[k : k + step]
                near = (numbers[i][:, None] != numbers[None, :]) & (np.bitwise_count(part[a:b][i][:, None] ^ part[a:b][None, :]) <= SLICE_RADIUS)
                found[a + i] |= near.any(axis=1)
                found[a:b] |= near.any(axis=0)
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (bucket, label, node)], names=["key", "label", "node"])


def _minorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, to, met) of those rows that are not of their bucket's commonest label: that label, and whether the bucket has a third."""
    for batch in _mixed(batches):
        key, label, node = (batch.column(k).to_numpy() for k in range(3))
        every = np.arange(len(key))
        run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])])  # rows come by bucket and label
        n = np.diff(np.r_[run, len(key)])
        order = np.lexsort((label[run], -n, key[run]))
        first = np.flatnonzero(np.r_[True, key[run][order][1:] != key[run][order][:-1]])
        labels = np.diff(np.r_[first, len(run)])
        bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        to, met = label[run][order][first][bucket], (labels > 2)[bucket]
        keep = every[label != to]
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, node, to, met)], names=["key", "node", "to", "met"])


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _alike(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.minimum(size[i], size[j]) >= LEAST * np.maximum(size[i], size[j])


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _nearest_before(label: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Pairs:
    """(i, j, distance) of each row and the nearest among the bucket's first and the rows shortly before it."""
    every = np.arange(len(label))
    best, least = np.full(len(label), -1), np.full(len(label), RADIUS + 1)
    for d in [*range(1, min(NEIGHBOURS + 1, len(label))), 0]:
        i = every[max(d, 1) :]
        j = i - d if d else np.zeros(len(i), np.int64)
        distance = np.where(_alike(size, i, j), _distance(prints[i], prints[j]), RADIUS + 1)
        nearer = distance < least[i]
        best[i[nearer]], least[i[nearer]] = j[nearer], distance[nearer]
    i = every[best >= 0]
    yield i, best[i], least[i]


def _apart(label: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Pairs:
    """(i, j, distance) of all candidates with different labels, by rows i that don't have the commonest label."""
    names, numbers, counts = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    common = numbers == counts.argmax()
    rows, step = np.flatnonzero(~common), max(1, BLOCK // (len(label) * WORDS64))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        fit = (numbers[i][:, None] != numbers[None, :]) & (common[None, :] | (np.arange(len(label))[None, :] > i[:, None]))
        a, b = np.nonzero(fit)
        a = i[a]
        keep = _alike(size, a, b)
        a, b = a[keep], b[keep]
        distance = _distance(prints[a], prints[b])
        keep = distance <= RADIUS
        if keep.any():
            yield a[keep], b[keep], distance[keep]


def _pair_batch(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(distance), pa.array(x)], names=["a", "b", "distance", "by"])


def _pairs(propose):
    """(a, b, distance, by), a < b, of a bucket."""

    def work(rows: pa.Table, label: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j, distance in propose(label, size, prints):
            yield _pair_batch(node[i], node[j], distance)

    return work


def _asked(rows: pa.Table, label: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Pairs:
    """(i, j, distance) of all candidates of a cell: a row i that asks the label ``to`` and one of its rows j, whose ``to`` is -1, that share a bucket."""
    to = rows.column("to").to_numpy()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(to), -1)
    asks, told = np.flatnonzero(to >= 0), np.flatnonzero(to < 0)
    if not len(asks) or not len(told):
        return
    buckets = keys_of(codes, prints) >> SLICE
    width = buckets.shape[1]
    order = buckets[told].argsort(axis=None, kind="stable")
    held, owner, step = buckets[told].ravel()[order], order // width, max(1, BLOCK // (8 * len(told) * width))
    for at in range(0, len(asks), step):
        part = asks[at : at + step]
        want = buckets[part].ravel()
        start = np.searchsorted(held, want)
        n = np.searchsorted(held, want, "right") - start
        met = np.zeros((len(part), len(told)), bool)
        met[np.repeat(np.arange(len(want)) // width, n), owner[np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)]] = True
        i, j = np.nonzero(met)
        i, j = part[i], told[j]
        keep = (to[i] == label[j]) & (label[i] != label[j]) & _alike(size, i, j)
        i, j = i[keep], j[keep]
        distance = _distance(prints[i], prints[j])
        keep = distance <= RADIUS
        if keep.any():
            yield i[keep], j[keep], distance[keep]


def _nearest_asked(rows: pa.Table, label: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b, distance, by), a < b: of a cell's candidates the nearest of each row that asks."""
    for i, j, distance in _asked(rows, label, size, prints):
        order = np.lexsort((node[j], distance, i))
        i, j, distance = i[order], j[order], distance[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        yield _pair_batch(node[i[first]], node[j[first]], distance[first])


def _slots(rows: pa.Table) -> np.ndarray:
    """Each row's sorted ``keys`` as TABLES x 4, -1 where there is none."""
    lists = rows.column("keys").combine_chunks()
    keys, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    table, every = keys >> (7 * KEY_SEGMENTS), np.arange(len(keys))
    new = np.r_[True, (owner[1:] != owner[:-1]) | (table[1:] != table[:-1])]
    out = np.full((len(lists), TABLES, 4), -1, np.int64)
    out[owner, table, every - np.maximum.accumulate(np.where(new, every, 0))] = keys
    return out


def _apart_first(rows: pa.Table, label: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Pairs:
    """The candidates with different labels that share no bucket before this one, so that each comes up in one bucket only."""
    slots, key = None, rows.column("key")[0].as_py()
    for i, j, distance in _apart(label, size, prints):
        slots, keep = _slots(rows) if slots is None else slots, np.ones(len(i), bool)
        for at in range(0, len(i), 4096):
            x, y = slots[i[at : at + 4096]], slots[j[at : at + 4096]]
            x = np.where(x < key, x, -1)
            for k in range(4):
                keep[at : at + 4096] &= ~((x == np.roll(y, k, axis=2)) & (x >= 0)).any(axis=(1, 2))
        if keep.any():
            yield i[keep], j[keep], distance[keep]


def _open(propose, names: list[str]):
    """The columns ``names`` of those rows of a bucket or cell that have a candidate."""

    def work(rows: pa.Table, label: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(node), bool)
        for i, j, _ in propose(rows, label, size, prints):
            found[i] = found[j] = True
        if found.any():
            yield from rows.select(names).filter(pa.array(found)).combine_chunks().to_batches()

    return work


def _settle(propose, rows: pa.Table, label: np.ndarray, node: np.ndarray, size: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b) of a bucket or cell: verified links, one for each two labels that any of its candidates joins."""
    texts = rows.column("text")
    sets: dict[int, np.ndarray] = {}
    over = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while over[x] != x:
            over[x] = x = over[over[x]]
        return x

    def shingles_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i].as_py())[1]
        return sets[i]

    found = []
    for i, j, distance in propose(rows, label, size, prints):
        for k in np.argsort(distance, kind="stable"):
            x, y = int(i[k]), int(j[k])
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q and similarity(shingles_of(x), shingles_of(y)) >= LEAST:
                over[max(p, q)] = min(p, q)
                found.append((min(node[x], node[y]), max(node[x], node[y])))
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_bucket(work):
    """What ``work`` makes of each bucket of two rows or more, from rows that come sorted by key."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            key, label, node, size = (table.column(i).to_numpy() for i in range(4))
            prints = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(-1, WORDS64)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                yield from work(table.slice(a, b - a), label[a:b], node[a:b], size[a:b], prints[a:b])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the bucket that may go on in the next batch
            if held and (last or key[0] != held[-1].column(0)[-1].as_py()):
                same = int(np.searchsorted(key, held[-1].column(0)[-1].as_py(), "right"))
                held.append(batch.slice(0, max(same, last)))
                yield from found()
                held, last = [], max(same, last)
                batch = batch.slice(last)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from found()

    return per_partition


def _met(held: DataFrame, work, schema: str) -> DataFrame:
    met = held.select(F.explode("keys").alias("key"), "label", "node", "size", "print", "keys")
    return met.repartition("key").sortWithinPartitions("key", "label", "node").mapInArrow(_by_bucket(work), schema)


def _few(rows: DataFrame) -> DataFrame:
    """rows, a written table, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of (a, piece, node, text), where a's own row leads those that it is compared with."""
    middle = None
    for batch in batches:
        found = []
        for a, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            hashes = shingle_set(text.as_py())[1]
            if a == node:
                middle = hashes
            elif similarity(middle, hashes) >= LEAST:
                found.append((a, node))
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, uri: str) -> DataFrame:
    """The pairs(a, b) whose texts(node, text) are as similar as LEAST; texts go to where they are compared once, STAR to a task's a."""
    pairs = materialize(pairs, f"{uri}/pairs")
    stars = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("last", F.call_function("div", F.col("n"), F.lit(STAR))), f"{uri}/stars")
    ends = skew_join(pairs, stars, "a", "n", ["b"]).select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("piece"), F.col("b").alias("node"))
    ends = ends.unionByName(stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("piece"), F.col("a").alias("node")))
    rows = texts.join(_few(materialize(ends, f"{uri}/ends")), "node").select("a", "piece", "node", "text")
    rows = rows.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("node") != F.col("a"), "node")
    return materialize(rows.mapInArrow(_verify, "a long, b long"), f"{uri}/links")


def _labelled(rows: DataFrame, roots: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """rows(node, ...) with the label of their node's component."""
    roots = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(roots, node, "left").withColumn(label, F.coalesce("_root", node)).drop("_root")


def _cells(asks: DataFrame, nodes: DataFrame, roots: DataFrame, uri: str) -> DataFrame:
    """(key, label, node, to): the texts of asks(node, to), and, with -1 for to, the nodes of the components that they ask.

    A component's members are dealt over cells in one direction, the texts that ask it in the other: each of them meets
    each member in one cell, and is there at most GRID times. Cells that share a key by chance stay apart by to.
    """
    asks = _labelled(_labelled(asks, roots), roots, "to", "to").where("label <> to").select("node", "label", "to").distinct()
    asks = materialize(asks, f"{uri}/asks")
    members = _labelled(nodes, roots)
    deal = lambda n: F.least(F.call_function("div", F.col(n), F.lit(CELL)) + 1, F.lit(GRID))
    grid = asks.groupBy(F.col("to").alias("_to")).agg(F.count("*").alias("s"))
    grid = members.groupBy("label").agg(F.count("*").alias("m")).join(grid, F.col("label") == F.col("_to")).select("label", "m", "s", deal("m").alias("down"), deal("s").alias("across"))
    grid = materialize(grid, f"{uri}/grid")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("node"), n)
    members = skew_join(members, grid.drop("s"), "label", "m", ["node"]).where("down is not null")
    members = members.select("label", "node", F.lit(-1).cast("long").alias("to"), F.col("label").alias("of"), one_of("down").alias("x"), all_of("across").alias("y"))
    askers = skew_join(asks, grid.drop("m").withColumnRenamed("label", "to"), "to", "s", ["node"])
    askers = askers.select("label", "node", "to", F.col("to").alias("of"), all_of("down").alias("x"), one_of("across").alias("y"))
    return materialize(members.unionByName(askers).select(F.xxhash64("of", "x", "y").alias("key"), "label", "node", "to"), f"{uri}/cells")


def _in_cells(told: DataFrame, cells: DataFrame, work, schema: str) -> DataFrame:
    """What work makes of each cell, with the columns of told(node, size, print, codes, ...)."""
    names = ["key", "label", "node", "size", "print", "codes", "to"]
    met = told.join(_few(cells), "node").select(*names, *(c for c in told.columns if c not in names))
    return met.repartition("key").sortWithinPartitions("key", "label", "node").mapInArrow(_by_bucket(work), schema)


def _kept(rows: DataFrame, doc_id: str, text: str, uri: str) -> DataFrame:
    """The _row of each row that stays."""
    texts = rows.select(F.col("_row").alias("node"), text_or_empty(text).alias("text"))
    told = rows.select(F.col("_row").alias("node"), F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    told = materialize(told.mapInArrow(_describe, f"node long, id {told.schema['id'].dataType.simpleString()}, content binary, size long, print binary, codes binary"), f"{uri}/told")
    first = F.min_by(F.struct("id", "node"), F.struct(F.col("id").isNull(), "id", "node")).alias("x")
    distinct = materialize(told.groupBy("content").agg(first).select("x.*"), f"{uri}/distinct")
    copies = materialize(told.select("node").join(distinct.select("node"), "node", "left_anti"), f"{uri}/copies")
    told = told.join(_few(copies), "node", "left_anti").where("size > 0")

    spread = told.select("node", "print", "codes").mapInArrow(_replicate, "key long, node long")
    bucket = F.shiftright("key", SLICE)
    met = materialize(spread.repartition(bucket).sortWithinPartitions(bucket, "node").mapInArrow(_meet, "key long, node long, first long, before long"), f"{uri}/met")
    table = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("key", SLICE + 7 * KEY_SEGMENTS).cast("int"))
    pairs = met.select(F.explode(F.array("first", "before")).alias("a"), F.col("node").alias("b"), table.alias("table")).where("a >= 0")
    pairs = pairs.groupBy("a", "b").agg(F.bit_count(F.bit_or("table")).alias("n")).where("n > 1")
    pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = _verified(pairs, texts, f"{uri}/0")

    roots = connected_components(links)
    apart = _labelled(met.select("key", "node"), roots).select("key", "label", "node")
    apart = materialize(apart.repartition(bucket).sortWithinPartitions(bucket, "label", "node").mapInArrow(_minorities, "key long, node long, to long, met boolean"), f"{uri}/apart")
    asks = materialize(apart.select("node", "to").distinct(), f"{uri}/asks")
    prints = told.select("node", "size", "print", "codes")
    cells = _cells(asks, told.select("node"), roots, f"{uri}/1")
    pairs = _in_cells(prints, cells, _nearest_asked, "a long, b long, distance long, by long").groupBy("by").agg(F.min(F.struct("distance", "a", "b")).alias("x"))
    links = links.unionByName(_verified(pairs.select("x.a", "x.b").distinct(), texts, f"{uri}/1"))

    roots = connected_components(links)
    cells = _cells(asks, told.select("node"), roots, f"{uri}/2")
    open_cells = materialize(_in_cells(prints, cells, _open(_asked, ["key", "label", "node", "to"]), "key long, label long, node long, to long"), f"{uri}/open-cells")
    nodes = apart.where("met").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    nodes = materialize(_labelled(told.select("node", "size", "print").join(nodes, "node"), roots), f"{uri}/nodes")
    still = materialize(_met(nodes, _open(_apart_first, ["key", "node"]), "key long, node long"), f"{uri}/open")
    ends = materialize(still.groupBy("node").agg(F.collect_list("key").alias("open")), f"{uri}/open-nodes")
    open_nodes = materialize(ends.select("node").union(open_cells.select("node")).distinct(), f"{uri}/open-either")
    held = materialize(texts.join(_few(open_nodes), "node"), f"{uri}/open-texts")
    settled = materialize(_in_cells(prints.join(held, "node"), open_cells, partial(_settle, _asked), "a long, b long"), f"{uri}/settled-cells")
    last = nodes.join(_few(ends), "node").join(held, "node")
    last = last.select(F.explode("open").alias("key"), "label", "node", "size", "print", "keys", "text").repartition("key").sortWithinPartitions("key", "label", "node")
    links = links.unionByName(settled).unionByName(materialize(last.mapInArrow(_by_bucket(partial(_settle, _apart_first)), "a long, b long"), f"{uri}/settled"))
    roots = connected_components(links)

    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("place")
    kept = distinct.select("id", "node").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(place)
    return kept.select(F.col("place.node").alias("_row"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of linked texts: that with the smallest doc_id (null ids last), all columns kept.

    Rows are told apart by their place in a written table, so repeated rows and ids leave one row too; null and empty
    texts and those of blanks are equal; fewer than five words give one shingle.
    """
    uri = work_uri(docs.sparkSession, "near-copies")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = materialize(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), f"{uri}/rows")
    by = dict(zip(docs.columns, names, strict=True))
    with cleaned(docs.sparkSession):
        kept = _kept(rows, by["doc_id"], by["text"], work_uri(docs.sparkSession, "near-copies-work"))
        dropped = materialize(rows.select("_row").join(kept, "_row", "left_anti"), f"{uri}/dropped")
    return rows.join(_few(dropped), "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in by.items()])

"""SimHash near-duplicates found at the points of a covering code.

Words are the runs of non-blank bytes of the lower-cased (A-Z only) UTF-8 text; features are the hashes of all
three-word shingles, repeats included.

Anchors are the words of the perfect Hamming code of length 63 (covering radius 1), with the 64th bit kept as it is.
Two fingerprints at distance 2 or less have a midpoint at distance 1 or less from both, and some anchor covers the
midpoint at distance 1 or less. So it is enough to replicate each fingerprint to every anchor within the covering
radius plus half the threshold: 33 rows at most. All pairs that must be compared meet at an anchor, and an anchor's
group is bounded by geometry (2081 distinct fingerprints), whatever the number of documents.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other; fewer
than three words give one shingle; repeated rows and repeated ids stay as rows of their own; a component whose ids are
all null has a null component_id; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, skew_join, text_or_empty, work_uri
from tessera.llm.graph import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42


def fingerprint(text: str) -> int:
    """The unsigned 64-bit SimHash of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(SHINGLE_WORDS, len(words))
    starts, stops = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs(doc_id, text), fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, fingerprint) pairs for an array of uint64 fingerprints."""
    one = np.uint64(1)
    syndrome = np.zeros(len(fps), np.uint64)
    for i in range(1, 64):
        syndrome ^= np.where((fps >> np.uint64(i - 1)) & one, np.uint64(i), np.uint64(0))
    top = one << np.uint64(63)
    word = syndrome == 0
    near = np.where(word, fps, fps ^ (one << np.where(word, np.uint64(0), syndrome - one)))
    anchors, owners = [near, near ^ top], [fps, fps]
    rest, s = fps[~word], syndrome[~word]
    for i in range(1, 64):
        j = s ^ np.uint64(i)
        keep = j > np.uint64(i)
        anchors.append(rest[keep] ^ (one << np.uint64(i - 1)) ^ (one << (j[keep] - one)))
        owners.append(rest[keep])
    return np.concatenate(anchors), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, owners = _anchors_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(owners.view(np.int64))], names=["anchor", "fp"])


def _local_roots(fps: np.ndarray, threshold: int) -> np.ndarray:
    """The smallest member of each member's component within one anchor's group."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= threshold
    labels = np.arange(len(fps))
    while True:
        new = np.where(close, labels[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return fps[labels]
        labels = new


def _links(threshold: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(anchors: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
            size = np.diff(np.r_[first, len(anchors)])
            out_a, out_b = [], []
            two = first[size == 2]
            x, y = fps[two], fps[two + 1]
            keep = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= threshold
            out_a.append(x[keep])
            out_b.append(y[keep])
            for at, n in zip(first[size > 2], size[size > 2], strict=True):
                group = fps[at : at + n]
                roots = _local_roots(group.view(np.uint64), threshold).view(np.int64)
                moved = roots != group
                out_a.append(group[moved])
                out_b.append(roots[moved])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.r_[held_a, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False)]
            last = np.searchsorted(anchors, anchors[-1])  # the group that may go on in the next batch
            held_a, held_f = anchors[last:], fps[last:]
            if last:
                yield linked(anchors[:last], fps[:last])
        if len(held_a):
            yield linked(held_a, held_f)

    return per_partition


def fingerprint_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints at ``threshold`` (at most 2) or fewer differing bits.

    Within an anchor a spanning star of each component stands for its pairs, so the edges stay linear in its size.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the replication radius of this code holds for thresholds 0 to 2")
    met = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor", "fp")
    return met.mapInArrow(_links(threshold), "a long, b long").distinct()


def simhash_components(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable over links."""
    uri = work_uri(docs.sparkSession, "simhash")
    fps = materialize(fingerprints(docs), f"{uri}/fps")
    return skew_join(fps, _classes(fps, threshold, uri), "fp", "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def _classes(fps: DataFrame, threshold: int, uri: str) -> DataFrame:
    """(fp, n, root, component_id) of each distinct fingerprint of fps(doc_id, fp), as a written table."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{uri}/distinct")
    roots = connected_components(fingerprint_links(distinct, threshold))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, f"{uri}/rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), f"{uri}/least")
    return materialize(skew_join(rooted, least, "root", "m", ["fp"]).select("fp", "n", "root", "component_id"), f"{uri}/classes")

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibration.

1. Random indexing. Every word hashes to one of WORDS buckets, and every bucket has a fixed sparse ternary index
   vector. A bucket's word vector is the sum of the index vectors of its neighbours (WINDOW words to either side) over
   the whole corpus. Each task sums over its part; the sums are added by an aggregate, and the model is a table of
   fixed size (WORDS x SIZE), whatever the corpus.
2. Pooling. A document is the mean and the deviation of its words' vectors, their mean product with the next word's
   vector (which tells repeated words), and the logarithm of its length, over its whole text.
3. Network. Two layers in numpy, fitted on at most ``sample`` labelled rows (a documented bound; training rows only),
   and a temperature fitted on a fifth of those rows that the weights never saw.

Scores depend on the text alone. Rows whose crc32 of the id's text modulo 4 is 2 are held out from learning labels.

Defined cases: a null text counts as empty and is pooled to zeros, so it gets a score too; a null id is not held out
and never labelled; null labels are ignored; repeated ones of an id count once, as do repeated rows of a
labelled id (the first text in order); without labels every score is 0.5, with one class the smoothed
base rate; repeated rows get equal scores; an empty table gives an empty result; other columns are
ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import text_or_empty

WORDS = 1 << 13
SIZE = 32
NONZERO = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
FEATURES = 3 * SIZE + 1
#: Words that are summed at once, and words that are pooled at once.
STEP, POOL_STEP = 1 << 19, 1 << 15


class Buckets(dict):
    """The packed buckets of a blank-free chunk's words, remembered for up to 300,000 chunks."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        found, last = array("H"), chunk[-1]
        if chunk.isalpha():  # the two commonest cases, as the pattern would part them
            words = (chunk,)
        elif chunk[:-1].isalpha() and not (last.isalnum() or last == "_"):
            words = (chunk[:-1], last)
        else:
            words = WORD.findall(chunk)
        for word in words:
            marked = word.lower() + ("^" if len(word) > 1 and word.isupper() else "")
            found.append(zlib.crc32(marked.encode("utf-8", "surrogatepass")) % WORDS)
        self[chunk] = packed = found.tobytes()
        return packed


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and the signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((WORDS, SIZE)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], (WORDS, NONZERO))


def words_of(texts, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of all texts, and each text's number of words."""
    packed = [b"".join(map(buckets.__getitem__, (text.as_py() or "").split())) for text in texts]
    return np.frombuffer(b"".join(packed), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in packed], np.int64)


def _pieces(column, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of characters, one row at least."""
    start = total = 0
    for i, x in enumerate(column):
        total += len(x.as_py() or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(column):
        yield start, len(column)


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    sums, buckets = np.zeros(WORDS * SIZE), Buckets()
    for batch in batches:
        for a, b in _pieces(batch.column(0)):
            words, counts = words_of(batch.column(0)[a:b], buckets)
            text = np.repeat(np.arange(len(counts)), counts)
            for at in range(0, len(words), STEP):
                for step in range(1, WINDOW + 1):
                    left, right = words[at : at + STEP], words[at + step : at + STEP + step]
                    left = left[: len(right)]
                    same = text[at : at + len(left)] == text[at + step : at + step + len(right)]
                    left, right = left[same], right[same]
                    for x, y in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            sums += np.bincount(x * SIZE + places[y, k], signs[y, k], WORDS * SIZE)
    table = sums.reshape(WORDS, SIZE)
    rows = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(table[rows]), pa.list_(pa.float64()))], names=["bucket", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit word vectors of all buckets, from the whole corpus; WORDS rows reach the driver at most."""
    sums = docs.select(text_or_empty().alias("text")).mapInArrow(_neighbour_sums, "bucket long, v array<double>")
    added = sums.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)])
    table = np.zeros((WORDS, SIZE))
    for row in added.collect():
        table[row[0]] = row[1:]
    # the index vector itself keeps buckets apart whose neighbours are alike
    places, signs = index_vectors()
    own = np.zeros((WORDS, SIZE))
    np.put_along_axis(own, places, signs, axis=1)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (np.divide(table, norm, out=np.zeros_like(table), where=norm > 0) + own / np.sqrt(NONZERO)).astype(np.float32)


def pooled(texts, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """FEATURES numbers for each text: mean, deviation and mean product with the next word's vector, and the length."""
    out = [np.zeros((0, FEATURES))]
    for a, b in _pieces(texts, 1 << 20):
        words, counts = words_of(texts[a:b], buckets)
        text = np.repeat(np.arange(len(counts)), counts)
        sums = np.zeros((3, len(counts), SIZE))
        for at in range(0, len(words), POOL_STEP):
            rows, after = text[at : at + POOL_STEP], text[at + 1 : at + POOL_STEP + 1]
            got = vectors[words[at : at + POOL_STEP + 1]]
            now, pairs = got[: len(rows)], np.zeros((len(rows), SIZE), np.float32)
            pairs[: len(after)] = got[: len(after)] * got[1 : len(after) + 1] * (rows[: len(after)] == after)[:, None]
            cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            for k, values in enumerate((now, now * now, pairs)):
                sums[k][rows[cuts]] += np.add.reduceat(values, cuts, axis=0, dtype=np.float64)
        n = np.maximum(counts, 1)[:, None]
        mean = sums[0] / n
        out.append(np.c_[mean, np.sqrt(np.maximum(0, sums[1] / n - mean**2)), sums[2] / np.maximum(n - 1, 1), np.log1p(counts)])
    return np.concatenate(out)


@dataclass
class Network:
    """x -> tanh(x w1 + b1) w2 + b2, divided by a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) * self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, seed: int = 3) -> Network:
    """Adam on the whole training part, weight decay, then the temperature on the other part."""
    width = x.shape[1] if x.ndim == 2 else FEATURES
    rng = np.random.default_rng(seed)
    shift = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = 1 / (x.std(axis=0) + 1e-6) if len(x) else np.ones(width)
    net = Network(shift, scale, rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    ones = int(y.sum())
    if ones in (0, len(y)) or len(y) < 20:
        net.b2 = float(np.log((ones + 1) / (len(y) - ones + 1)))
        return net
    net.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    late = np.zeros(len(y), bool)
    late[rng.permutation(len(y))[: len(y) // 5]] = True
    z, t = (x[~late] - shift) * scale, y[~late].astype(float)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
    for k in range(1, rounds + 1):
        hidden = np.tanh(z @ values[0] + values[1])
        d = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3][0], -40, 40))) - t) / len(t)
        back = np.outer(d, values[2]) * (1 - hidden**2)
        for i, g in enumerate((z.T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ d + 1e-4 * values[2], np.array([d.sum()]))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            values[i] -= 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    held = net.logits(x[late])
    truth = np.where(y[late] == 1, 1 - 1 / (ones + 2), 1 / (len(y) - ones + 2))  # as if each class had one more error
    net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=lambda s: loss(held / s, truth)))
    return net


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, and the network from about ``sample`` labelled ids at most, each with one row per label."""
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    known = known.distinct()  # so there are two rows of an id at most
    n = known.agg(F.count_distinct("doc_id")).first()[0]
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(n)) < sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(pooled(batch.column(0), vectors, buckets)), pa.list_(pa.float64()))], names=["quality", "x"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality").mapInArrow(features, "quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r.quality, r.x))  # the same network whatever the order of tasks
    return vectors, fit(np.array([r.x for r in rows]).reshape(len(rows), FEATURES), np.array([r.quality for r in rows], int))


def scores(docs: DataFrame, model: tuple[np.ndarray, Network], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs under the names _k0, _k1, ..., and ``_score``, per row."""
    vectors, net = model
    own = [f"_c{i}" for i in range(len(docs.columns))]
    by = dict(zip(docs.columns, own, strict=True))
    rows = docs.toDF(*own).select(*[F.col(by[c]).alias(f"_k{i}") for i, c in enumerate(keep)], text_or_empty(by["text"]).alias("_t"))
    names = rows.columns[:-1]

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            x = pooled(batch.column(batch.num_columns - 1), vectors, buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(net.probabilities(x))], names=[*names, "_score"])

    schema = StructType([*rows.schema.fields[:-1], StructField("_score", DoubleType())])
    return rows.mapInArrow(per_partition, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = scores(docs, train(docs, labels), ["doc_id"]).withColumnRenamed("_k0", "doc_id")
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects, all columns kept."""
    rows = scores(docs, train(docs, labels), docs.columns).where(F.col("_score") >= threshold)
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a document with k = floor(n * error_rate) edits or fewer. It is cut into
k + 1 pieces; by the pigeonhole principle one of them occurs unchanged. All pieces of all items are searched at once
(Aho-Corasick), and each hit is verified with Myers' bit-parallel distance. Verification climbs a binary tree over the
pieces: a node of p pieces has the budget p - 1, and if it holds, one of its two halves holds, so a hit is given up at
the first ancestor that fails and no occurrence is lost.

Texts and items are compared in lower case with runs of white space as one space. Items travel as a broadcast, in sets
of at most ``set_bytes``, which is all that the driver and a worker hold of the benchmark; a set's items are matched in
groups of at most ``group_bytes``. A set makes one pass over the documents, whatever its number of groups: tasks take
the documents in chunks and go through all groups per chunk. Another set reads what the pass before it has written.

Defined cases: null and blank texts hold no item; null and blank items are left out; items of fewer than ``least``
characters are searched without edits and between word ends; those below SHORTEST would be in most texts and are not
searched, ``unsearched`` lists them; repeated items are searched once and reported under every id; an item with a null
id counts for ``least_distance`` and for ``clean_documents`` and is not in ``item_ids``; repeated documents are rows of
their own; empty tables give results without matches. Other columns, whatever their names, are ignored by ``matches``
and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.common import materialize, work_uri

ERROR_RATE = 0.1
LEAST_CHARS = 24
SHORTEST = 8
GROUP_BYTES, SET_BYTES = 1 << 23, 1 << 26
#: Characters of documents that go through all groups at a time, where there are several.
CHUNK = 1 << 26


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance_within(pattern: str, text: str, budget: int, peq: dict[str, int] | None = None) -> int | None:
    """The least edit distance of pattern to any part of text if it is at most budget (Myers 1999)."""
    m = len(pattern)
    if peq is None:
        peq = positions(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & mask
        plus = down << 1 & mask | (mask & ~(vertical | up))
        minus = up & vertical
    return best if best <= budget else None


def positions(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


class Matcher:
    """Searches normalized texts for a group of normalized items; those shorter than ``least`` whole, between word ends."""

    def __init__(self, items: list[str], error_rate: float, least: int = 0):
        import ahocorasick

        self.least, self.items, self.nodes, self.found_at = least, items, {}, defaultdict(list)
        self.machine = ahocorasick.Automaton()
        for k, item in enumerate(items):
            n = int(len(item) * error_rate) + 1 if len(item) >= least else 1
            cuts = [len(item) * j // n for j in range(n + 1)]
            for j in range(n):
                path, lo, hi = [], 0, n
                while hi - lo > 1:
                    path.append((cuts[lo], cuts[hi], hi - lo - 1))
                    middle = (lo + hi) // 2
                    lo, hi = (lo, middle) if j < middle else (middle, hi)
                self.found_at[item[cuts[j] : cuts[j + 1]]].append((k, cuts[j], path[::-1]))
        for piece in self.found_at:
            self.machine.add_word(piece, piece)
        if items:
            self.machine.make_automaton()

    def _node(self, k: int, a: int, b: int) -> tuple[str, dict[str, int]]:
        key = (k, a, b)
        if key not in self.nodes:
            pattern = self.items[k][a:b]
            self.nodes[key] = pattern, positions(pattern)
        return self.nodes[key]

    def search(self, text: str) -> dict[int, int]:
        """The least distance of each item found in text."""
        best: dict[int, int] = {}
        if not self.items or not text:
            return best
        tried: set[tuple[int, int, int]] = set()
        for end, piece in self.machine.iter(text):
            start = end - len(piece) + 1
            for k, a, path in self.found_at[piece]:
                if best.get(k) == 0 or (k, a, start) in tried:
                    continue
                tried.add((k, a, start))
                if len(self.items[k]) < self.least and (text[start - 1 : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                    continue
                distance = 0
                for lo, hi, budget in path:
                    pattern, peq = self._node(k, lo, hi)
                    at = start - (a - lo) - budget
                    distance = distance_within(pattern, text[max(0, at) : at + (hi - lo) + 2 * budget], budget, peq)
                    if distance is None:
                        break
                if distance is not None and distance < best.get(k, 1 << 30):
                    best[k] = distance
        return best


def _numbered(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def unsearched(items: DataFrame) -> DataFrame:
    """(item_id, text) of the items that are too short to be searched."""
    at = F.char_length(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return _numbered(items).where(F.coalesce(at, F.lit(0)) < SHORTEST)


Group = list[tuple[str, list[int]]]


def item_sets(items: DataFrame, group_bytes: int, set_bytes: int) -> Iterator[list[Group]]:
    """Normalized items with their ids, in sets of groups of bounded size; one set at a time is on the driver."""
    groups: list[dict[str, list[int]]] = [defaultdict(list)]
    total = own = 0
    for row in _numbered(items).where("text is not null").orderBy("item_id").toLocalIterator():
        text = normalize(row.text)
        if len(text) < SHORTEST:
            continue
        size = 4 * len(text) + 64
        if groups[-1] and own + size > group_bytes:
            if total + size > set_bytes:
                yield [list(g.items()) for g in groups]
                groups, total = [], 0
            groups.append(defaultdict(list))
            own = 0
        own, total = own + size, total + size
        groups[-1][text] += [] if row.item_id is None else [row.item_id]
    if groups[-1]:
        yield [list(g.items()) for g in groups]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(batch.num_columns - 3).nbytes
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _pass(sent: Broadcast, error_rate: float, least: int):
    """Adds a set's items to those that earlier passes found; the text is the third column from the end."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[Group] = sent.value
        order, matcher, made = list(range(len(groups))), None, -1
        for chunk in _chunks(batches, CHUNK if len(groups) > 1 else 0):
            texts = [normalize(x.as_py()) for b in chunk for x in b.column(b.num_columns - 3)]
            ids = [x or [] for b in chunk for x in b.column(b.num_columns - 2).to_pylist()]
            nearest = [x for b in chunk for x in b.column(b.num_columns - 1).to_pylist()]
            for g in order:
                if g != made:
                    matcher, made = Matcher([text for text, _ in groups[g]], error_rate, least), g
                for i, text in enumerate(texts):
                    if found := matcher.search(text):
                        ids[i] = sorted([*ids[i], *(x for k in found for x in groups[g][k][1])])
                        nearest[i] = min([*found.values()] + [nearest[i]] * (nearest[i] is not None))
            order.reverse()  # the next chunk begins with the group at hand
            at = 0
            for batch in chunk:
                upto = at + batch.num_rows
                columns = [*batch.columns[:-2], pa.array(ids[at:upto], pa.list_(pa.int64())), pa.array(nearest[at:upto], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                at = upto

    return per_partition


def _search(docs: DataFrame, items: DataFrame, keep: list[str], error_rate: float, least: int, group_bytes: int, set_bytes: int) -> DataFrame:
    """The columns ``keep`` under the names _k0, _k1, ..., and _t, _ids, _least."""
    spark, names = docs.sparkSession, [f"_c{i}" for i in range(len(docs.columns))]
    by = dict(zip(docs.columns, names, strict=True))
    kept = [F.col(by[c]).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.toDF(*names).select(*kept, F.col(by["text"]).cast("string").alias("_t"), F.array().cast("array<bigint>").alias("_ids"), F.lit(None).cast("bigint").alias("_least"))
    schema = StructType([*rows.schema.fields[:-2], StructField("_ids", ArrayType(LongType())), StructField("_least", LongType())])
    uri = work_uri(spark, "items")
    for k, groups in enumerate(item_sets(items, group_bytes, set_bytes)):
        if k:
            rows = materialize(rows, f"{uri}/{k}")
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(groups), error_rate, least), schema)
    return rows


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, least: int = LEAST_CHARS, group_bytes: int = GROUP_BYTES, set_bytes: int = SET_BYTES) -> DataFrame:
    """(doc_id, item_ids, least_distance) per row: the sorted test items that the document holds, and the nearest's distance."""
    rows = _search(docs, items, ["doc_id"], error_rate, least, group_bytes, set_bytes)
    return rows.select(F.col("_k0").alias("doc_id"), F.col("_ids").alias("item_ids"), F.col("_least").alias("least_distance"))


def clean_documents(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, least: int = LEAST_CHARS, group_bytes: int = GROUP_BYTES, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without the rows that hold a test item, all columns kept."""
    rows = _search(docs, items, docs.columns, error_rate, least, group_bytes, set_bytes).where("_least is null")
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])

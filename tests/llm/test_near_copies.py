"""Near copies for the pipeline's stage against all pairs."""

import contextlib
import pathlib
import random

import pytest

from tessera.llm import nearcopies

from tests.llm.test_first_operators import union_find


def jaccard(x, y):
    x, y = x.lower().split(), y.lower().split()
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x, y))
    return len(a & b) / len(a | b)


def test_planted_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60, 400))) for _ in range(150)]
    for i in range(100):  # copies with a changed word here and there, by similarity from 0.6 to 1
        tokens = texts[i].split()
        for _ in range(rng.randrange(1, max(2, len(tokens) // 25))):
            tokens[rng.randrange(len(tokens))] = "changed"
        texts.append(" ".join(tokens))
    family = texts[149].split()
    for i in range(80):  # a large family, linked through its first member
        tokens = list(family)
        for k in range(rng.randrange(1, 4)):
            tokens[rng.randrange(len(tokens))] = f"x{i}.{k}"
        texts.append(" ".join(tokens))
    texts += [texts[0].upper(), "", " ", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i].lower().split() == texts[j].lower().split() or jaccard(texts[i], texts[j]) >= 0.8]
    roots = union_find(range(len(texts)), links)
    want = {min(i for i in range(len(texts)) if roots[i] == r) for r in {roots[i] for i in range(len(texts))}}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 160 < len(want) < 250


def test_long_fingerprint_counts_bits():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 1 << 63, 40_000, np.uint64)
    x = (hashes[None, :] ^ nearcopies._SEEDS) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    ones = [[int(((x[w] >> np.uint64(8 * byte + bit)) & np.uint64(1)).sum()) for bit in range(8) for byte in range(8)] for w in range(nearcopies.WORDS64)]
    want = np.packbits(2 * np.array(ones) > 40_000, axis=1).view(np.uint64).ravel()
    got, least = nearcopies.long_fingerprint(hashes)
    assert (got == want).all() and (least == x.min(axis=1)).all()


def test_buckets_over_many_batches():
    """Candidates don't depend on how rows are cut into batches."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 30, 400))
    base = rng.integers(0, 1 << 63, (1, nearcopies.WORDS64), np.uint64)
    prints = base ^ (np.uint64(1) << rng.integers(0, 60, (400, nearcopies.WORDS64)).astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(rng.integers(0, 5, 400)), pa.array(np.arange(400)), pa.array(np.full(400, 9)), pa.array([x.tobytes() for x in prints])], names=["key", "label", "node", "size", "print"])
    for pairs in (nearcopies._apart, nearcopies._nearest_before):
        run = lambda step: sorted(zip(*(np.concatenate(c).tolist() for c in zip(*([b.column(k).to_numpy() for k in range(4)] for b in nearcopies._by_bucket(nearcopies._pairs(pairs))(batch.slice(i, step) for i in range(0, 400, step))), strict=True)), strict=True))  # noqa: E731, B023
        whole = run(400)
        assert len(whole) > 300 and all(run(step) == whole for step in (1, 3, 17, 150))


def test_dropped_rows_by_broadcast_or_shuffle(spark, monkeypatch):
    """Both joins leave the same rows, and only the rows and those to drop stay in the shared folder."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    rows = [(i % 7 if i % 5 else None, f"one two three four five six {i % 4}", i) for i in range(40)] + [(None, None, 41), (None, None, 42)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long"), set(shared.iterdir())
    small = nearcopies.keep_one(docs)
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", 0)
    large = nearcopies.keep_one(docs)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.columns == docs.columns
    assert ["strategy=broadcast" in x._jdf.queryExecution().optimizedPlan().toString() for x in (small, large)] == [True, False]
    assert {y.name for x in set(shared.iterdir()) - before for y in x.iterdir()} == {"rows", "dropped"}


def test_fingerprints_meet_at_the_nearest_code_words():
    """Keys come from the SimHash fingerprints; pairs at similarity 0.8 share some, others do not."""
    import numpy as np

    rng = np.random.default_rng(3)
    margins, prints = [], []
    for _ in range(300):
        both, mine, other = (rng.integers(0, 1 << 63, n, np.uint64) for n in (160, 20, 20))
        for own in (mine, other):
            hashes = np.unique(np.concatenate([both, own]))
            prints.append(nearcopies.long_fingerprint(hashes)[0])
            margins.append(2 * nearcopies._tally(hashes)[0] - len(hashes))
    margins, prints = np.array(margins, np.float32), np.array(prints)
    codes = nearcopies.anchors(margins)
    words = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(64)] for i in range(64)])  # first-order Reed-Muller, half of it
    words = np.stack([words, -words], axis=1).reshape(128, 64)
    segment = margins[:20, nearcopies._ORDERS[1]].reshape(20, 16, 64)
    agree = segment @ words.T
    assert (np.take_along_axis(agree, codes[:20, 16:32].astype(int)[..., None], 2)[..., 0] == agree.max(axis=2)).all()
    buckets = nearcopies.keys_of(codes, prints) >> nearcopies.SLICE
    assert buckets.shape == (600, 4 * nearcopies.TABLES) and all(len(set(b)) == 4 * nearcopies.TABLES for b in buckets.tolist())
    meet = lambda i, j: bool(set(buckets[i]) & set(buckets[j]))
    assert sum(meet(i, i + 1) for i in range(0, 600, 2)) >= 297
    assert sum(meet(i, j) for i in range(0, 600, 2) for j in range(0, i, 2)) <= 3


def test_a_candidate_comes_up_in_one_bucket():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, base = 60, rng.integers(0, 1 << 63, nearcopies.WORDS64, np.uint64)
    keys = [sorted({int(t) << 28 | int(rng.integers(0, 3)) for t in rng.integers(0, nearcopies.TABLES, 12)}) for _ in range(n)]
    label, size = rng.integers(0, 6, n), np.full(n, 9)
    came = []
    for key in sorted({k for x in keys for k in x}):
        rows = np.array([i for i in range(n) if key in keys[i]])
        held = pa.table({"key": [key] * len(rows), "keys": pa.array([keys[i] for i in rows], pa.list_(pa.int64()))})
        for i, j, _ in nearcopies._apart_first(held, label[rows], size[rows], np.tile(base, (len(rows), 1))):
            came += [tuple(sorted(x)) for x in zip(rows[i].tolist(), rows[j].tolist(), strict=True)]
    want = {(i, j) for j in range(n) for i in range(j) if label[i] != label[j] and set(keys[i]) & set(keys[j])}
    assert len(came) == len(set(came)) and set(came) == want and len(want) > 500


def test_rows_that_meet_over_many_batches():
    """Rows in buckets of two or more, however they are cut into batches; those of another label near by."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    bucket, part = np.sort(rng.integers(0, 150, 400)), rng.choice([0, 7, (1 << 30) - 1], 400)
    key, label, node = bucket << nearcopies.SLICE | part, rng.integers(0, 3, 400), np.arange(400)
    for work, columns in ((nearcopies._meet, (key, node)), (nearcopies._mixed, (key, label, node))):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abc")[: len(columns)])
        run = lambda step: [tuple(r.values()) for b in work(batch.slice(i, step) for i in range(0, 400, step)) for r in b.to_pylist()]  # noqa: E731, B023
        whole = run(400)
        assert len(whole) > 200 and all(run(step) == whole for step in (1, 3, 17, 150))
    near = {n for n in range(400) if any(bucket[m] == bucket[n] and label[m] != label[n] and int(part[m] ^ part[n]).bit_count() <= nearcopies.SLICE_RADIUS for m in range(400))}
    assert {x[2] for x in whole} == near


def test_a_linked_family_is_not_replicated_for_its_strays(spark, monkeypatch):
    """Texts near a large component but not linked with it ask it; its members don't go to all their keys."""
    rng, written, write = random.Random(11), {}, nearcopies.materialize
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):  # the last ten have a similarity to the others below 0.75
        tokens = list(base)
        for k in rng.sample(range(0, 300, 6), 2 if i < 140 else 10):
            tokens[k + 2] = f"x{i}.{k}"
        texts.append(" ".join(tokens))
    monkeypatch.setattr(nearcopies, "CELL", 40)
    monkeypatch.setattr(nearcopies, "materialize", lambda df, uri: written.setdefault(uri.split("/", 3)[-1].split("/", 1)[-1], write(df, uri)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(nearcopies, "cleaned", lambda spark: contextlib.nullcontext())
        got = {r.doc_id for r in nearcopies.keep_one(docs).collect()}
    assert got == {0, *range(140, 150)}
    rows = {k.rsplit("/", 1)[-1]: v for k, v in written.items()}
    assert 100 < rows["apart"].count() < 3000


def test_cells_bring_each_asker_to_each_member_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", 4)
    monkeypatch.setattr(nearcopies, "GRID", 3)
    roots = spark.createDataFrame([(i, i // 40 * 40) for i in range(80)], "node long, root long")
    nodes = spark.range(120).toDF("node")
    asks = [(i, 0) for i in range(40, 120)] + [(i, 7) for i in range(70, 90)] + [(100, 101), (101, 100), (3, 0)]
    cells = nearcopies._cells(spark.createDataFrame(asks, "node long, to long"), nodes, roots, f"file://{tmp_path}").collect()
    label = lambda i: i // 40 * 40 if i < 80 else i
    assert all(r.label == label(r.node) for r in cells)
    met = [(x.node, y.node) for x in cells for y in cells if x.key == y.key and x.to >= 0 > y.to and x.to == y.label]
    want = {(i, j) for i, to in asks for j in range(120) if label(j) == label(to) != label(i)}
    assert len(met) == len(set(met)) and set(met) == want and len(want) > 3000
    assert len({r.key for r in cells if label(r.node) == 0 and r.to < 0}) == 9


def test_asked_against_all_pairs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(12)
    hashes = [rng.integers(0, 1 << 63, 200, np.uint64) for _ in range(3)]
    own = [np.unique(np.r_[hashes[i % 3][: rng.integers(150, 200)], rng.integers(0, 1 << 63, 20, np.uint64)]) for i in range(90)]
    prints = np.array([nearcopies.long_fingerprint(x)[0] for x in own])
    codes = nearcopies.anchors(np.array([2 * nearcopies._tally(x)[0] - len(x) for x in own], np.float32))
    size, label, to = np.array([len(x) for x in own]), rng.integers(0, 4, 90), rng.integers(-3, 4, 90).clip(-1)
    rows = pa.table({"to": to, "codes": pa.array([x.tobytes() for x in codes], pa.binary())})
    buckets = [set((x >> nearcopies.SLICE).tolist()) for x in nearcopies.keys_of(codes, prints)]
    distance = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())
    fit = lambda i, j: to[i] == label[j] != label[i] and to[j] < 0 and min(size[i], size[j]) >= nearcopies.LEAST * max(size[i], size[j])
    want = sorted((i, j, distance(i, j)) for i in range(90) for j in range(90) if to[i] >= 0 and fit(i, j) and buckets[i] & buckets[j] and distance(i, j) <= nearcopies.RADIUS)
    for block in (nearcopies.BLOCK, 1):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        got = sorted(x for part in nearcopies._asked(rows, label, size, prints) for x in zip(*(c.tolist() for c in part), strict=True))
        assert got == want and len(want) > 40


def test_minorities_ask_the_commonest_label():
    import numpy as np
    import pyarrow as pa

    bucket = np.array([1, 1, 1, 2, 2, 3, 3, 3, 3, 4])
    label, node = np.array([5, 6, 6, 7, 8, 1, 2, 2, 9, 3]), np.arange(10)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket << nearcopies.SLICE, label, node)], names=["key", "label", "node"])
    for step in (1, 3, 10):
        got = [tuple(r.values()) for b in nearcopies._minorities(batch.slice(i, step) for i in range(0, 10, step)) for r in b.to_pylist()]
        assert got == [(1, 0, 6, False), (2, 4, 7, False), (3, 5, 2, True), (3, 8, 2, True)]

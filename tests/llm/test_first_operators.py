"""Operators 1, 3, 6, 8 and 10 against brute force on small tables with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import graph, matroska, simhash, sstable, systematic, warc

TEXTS = [None, "", "a", "A b", "a b c", "a b c d e f g", "a b c d e f g", "x y  z\x85q É'S don't 12 <|endoftext|>end", "new\x1cline İstanbul ΣΑΣ é", "w " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["the", "and", "lo", "ré", "zz9", "under", "over,", "BIG"]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 300))), [None, "s0", "é"][i % 3]) for i in range(60)]
    rows += [rows[20], rows[20], (None, "orphan text of no id", "s1"), (rows[30][0], "same id other text", "s1")]
    return spark.createDataFrame([(*r, 1, "f", 2) for r in rows], "doc_id long, text string, source string, n_chars long, fp string, anchor int")


def test_warc_round_trip(spark):
    pages = [(3, "http://a", "one"), (1, "http://b\r\nx", "one"), (2, None, None), (7, "u", ""), (5, "v", "two"), (5, "v", "two"), (None, "w", "one"), (9, "é", "é" * 9000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload_digest string")
    rows = warc.deduplicate_pages(df.repartition(3)).collect()
    assert len(rows) == len(pages)
    groups = defaultdict(list)
    for r in rows:
        groups[r.payload_digest].append(r)
    assert {d: len(g) for d, g in groups.items()} == Counter(warc.payload_digest((p[2] or "").encode()) for p in pages)
    for g in groups.values():
        first = min(r.page_id for r in g if r.page_id is not None)
        assert [r.page_id for r in g if r.record_type == "response"] == [first]
        assert all(r.refers_to == first for r in g if r.record_type == "revisit")
        assert all(r.refers_to is None for r in g if r.record_type == "response")
        assert len({r.payload_bytes for r in g}) == 1
    assert {r.page_id: r.payload_bytes for r in rows}[9] == 18000
    assert len({r.record_id for r in rows}) == len(rows)
    assert warc.deduplicate_pages(df, least=4).where("record_type = 'revisit'").count() == 0
    assert warc.deduplicate_pages(df.limit(0)).count() == 0


def test_tokens_round_trip(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = sstable.write_shards(docs, P.path("word_bpe_49k.json"), shard_bytes=1500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(manifest).collect())
    rows = docs.collect()
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter(x[1:] for x in got) == want
    assert [x[1] for x in got] == sorted([r.doc_id for r in rows], key=lambda i: -1 if i is None else i)
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_shard_lookup(tmp_path):
    keys = sorted([None, *range(-50, 5000, 3), 7, 7, 7], key=lambda i: sstable.key_of(i))
    path = tmp_path / "x.sst"
    with path.open("wb") as out:
        w = sstable.Writer(out, 2)
        for k, i in enumerate(keys):
            w.add(sstable.key_of(i), np.arange(k % 700, dtype="<u2").tobytes())
        w.finish()
    assert path.stat().st_size == w.at and len(w.index) > 3
    with path.open("rb") as source:
        r = sstable.Reader(source, w.at)
        assert [sstable.id_of(k) for k, _ in r.scan()] == keys
        for i in (None, -50, 4, 7, 4999, 1001):
            assert [len(x) for x in r.get(i)] == [k % 700 for k, j in enumerate(keys) if j == i]
        assert sum(bool(r.get(i)) for i in range(6000, 7000)) == 0


@pytest.mark.parametrize("lacing", matroska.LACINGS)
def test_matroska_lacings(lacing):
    data = bytes(range(256)) * 720
    media = matroska.mux(data, lacing)
    rows = matroska.demux(media)
    assert b"".join(media[at : at + n] for _, _, at, n, *_ in rows) == data
    assert [r[1] for r in rows] == [i * 12_000_000 for i in range(len(rows))]
    assert all(r[6] for r in rows)


def test_matroska_uneven_frames_and_unknown_size():
    frames = [b"a" * 300, b"b" * 5, b"c" * 999, b"", b"d" * 70000, b"e"]
    for lacing in ("xiph", "ebml"):
        flags, body = matroska.laced(frames, lacing)
        block = b"\x82\x00\x05" + bytes([flags]) + body
        cluster = matroska.number(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
        data = bytes.fromhex("18538067 01ffffffffffffff 1f43b675 01ffffffffffffff") + cluster
        rows = matroska.demux(data)
        assert [data[at : at + n] for _, _, at, n, *_ in rows] == frames
        assert {(r[0], r[1], r[4]) for r in rows} == {(2, 12_000_000, lacing)}


def test_matroska_digests(spark, docs):
    """Every column from the texts and the stored bytes alone."""
    media = docs.sparkSession.createDataFrame(matroska.with_media(docs).collect(), "doc_id long, n_bytes long, media binary")
    stored = defaultdict(list)
    for r in media.collect():
        stored[r.doc_id].append(bytes(r.media))
    got = defaultdict(list)
    for r in matroska.payload_digests(media).collect():
        got[r.doc_id].append(tuple(r))
    features = defaultdict(set)
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        n = len(payload) // 576
        for file, row in zip(stored[r.doc_id], got[r.doc_id], strict=True):
            feature = dict(x.split("=") for x in row[7].split(";"))
            if row[3] != hashlib.sha256(payload).hexdigest():
                continue  # another row of that id
            assert row[:7] == (r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
            assert int(feature["packets"]) == n and int(feature["last_ns"]) == (n - 1) * 12_000_000 and feature["tracks"] == "1"
            at = 0
            for k in range(n):  # the frames lie in the file, in order
                at = file.index(payload[576 * k : 576 * k + 576], at) + 576
            assert int(feature["last_at"]) + 576 == at
            features[payload].add(row[4:])
            break
        else:
            raise AssertionError(r.doc_id)
    assert all(len(x) == 1 for x in features.values())
    assert matroska.packets(matroska.with_media(docs)).where("doc_id = 9").count() == -(-10000 // 576)
    assert matroska.payload_digests(matroska.with_media(docs.limit(0))).count() == 0


def test_matroska_refuses_what_leaves_its_parent():
    inner = matroska.element(matroska.SIMPLE_BLOCK, b"\x81" + bytes(50))
    cluster = matroska.element(matroska.CLUSTER, inner)
    bad = cluster[:-len(inner)].replace(bytes([cluster[-len(inner) - 1]]), bytes([cluster[-len(inner) - 1] - 9])) + inner + bytes(40)
    with pytest.raises(ValueError, match="parent"):
        list(matroska.elements(bad, 0, len(bad)))


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def union_find(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash(docs):
    rows = docs.collect()
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs).collect())
    prints = [slow_fingerprint(r.text or "") for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union_find(range(len(rows)), edges)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[roots[i]].append(r.doc_id)
    want = Counter((r.doc_id, prints[i], min(least[roots[i]]) if least[roots[i]] else None) for i, r in enumerate(rows))
    assert got == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.choice([1, 2, 3]))) for b in base for _ in range(12)]
    fps = sorted(set(base + near + [0, 1 << 63, (1 << 64) - 1, 3, 7]))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    got = union_find([x for x, in signed], [(r.a, r.b) for r in links.collect()])
    want = union_find([x for x, in signed], [(signed[i][0], signed[j][0]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == want


def test_components_of_a_long_path_and_a_hub(spark):
    rng = random.Random(2)
    path = list(range(0, 400))
    rng.shuffle(path)
    edges = [*zip(path, path[1:]), *((1000, 1000 + i) for i in range(1, 300)), (5, 5)]
    rows = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in path} | {1000 + i: 1000 for i in range(300)}


def test_components_over_many_tasks(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(5000 + i, 5001 + i) for i in range(300)] + [(-7, 9000 + i) for i in range(300)] + [(-(1 << 62), 1 << 62)] * 3
    monkeypatch.setattr(graph, "TASK_EDGES", 40)
    monkeypatch.setattr(graph, "_are_stars", lambda df, real=graph._are_stars, seen=(seen := []): seen.append(real(df)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        rows = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert len(rows) == len(nodes) and {r.node: r.root for r in rows} == union_find(nodes, edges)
    assert seen[-1] and len(seen) > 1  # the tasks' stars alone were not enough
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_stars():
    rng = random.Random(6)
    for n in (0, 1, 5, 200):
        edges = [(rng.randrange(-n - 1, n + 1), rng.randrange(n + 1)) for _ in range(n)]
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        node, root = graph.spanning_stars(a, b)
        want = union_find(sorted({x for e in edges for x in e}), edges)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}


def test_systematic_mix(spark, docs):
    rows = systematic.mix(docs).collect()
    assert len(rows) == docs.count()
    again = systematic.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(rows, key=key) == sorted(again, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    sizes = {s: sum(r.size for r in g) for s, g in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s, g in by.items():
        want = 2 * sizes[s] if s in full else level * weight[s]
        assert g[0].target == pytest.approx(want) and g[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in g) - want) <= 2 * max(r.size for r in g)
    assert systematic.mix(docs.limit(0)).count() == 0

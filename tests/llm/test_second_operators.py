"""Operators 4, 5, 7 and 9 against brute force, on small tables with nulls, repeats, ties and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, extendible, licenses, quality

WORDS = ["the", "and", "lore", "réa", "zz9", "under", "over", "big", "to", "a"]


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        rng.choice([lambda i: text.__setitem__(i, "q"), lambda i: text.insert(i, "q"), lambda i: text.pop(i)])(i)
    return "".join(text)


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(300):
        pattern, text = "".join(rng.choices("ab ", k=rng.randrange(1, 90))), "".join(rng.choices("ab ", k=rng.randrange(0, 60)))
        want = least_distance(pattern, text)
        assert decontaminate.distance_within(pattern, text, 1000) == want
        assert decontaminate.distance_within(pattern, text, want - 1) is None


@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_decontamination(spark, group_bytes):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(12, 40))) for i in range(14)] + [(50, None), (51, "  "), (52, "short"), (None, "an item without any id at all"), (60, None)]
    items[3] = (3, items[2][1].upper().replace(" ", "\n\n"))
    texts = [None, "", items[0][1], "Z" + items[2][1].title().replace(" ", " \t") + "z", "long " * 3000 + items[5][1] + " tail " * 3000]
    for i, text in items[:14]:
        n = int(len(decontaminate.normalize(text)) * 0.1)
        texts += [sentence(rng, 30) + edited(rng, text, k) + sentence(rng, 5) for k in (1, n - 1, n, n + 1, n + 4)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1), (None, texts[2], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string, least_distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, tuple(r.item_ids), r.least_distance) for r in decontaminate.matches(docs, bench, group_bytes=group_bytes).collect())
    want = Counter()
    for i, t, *_ in rows:
        if t and len(t) > 5000:
            want[i, (5,), 0] += 1
            continue
        text, found = decontaminate.normalize(t), {}
        for k, item in items:
            item = decontaminate.normalize(item)
            if k is not None and len(item) >= decontaminate.LEAST_CHARS:
                d = least_distance(item, text)
                if d <= int(len(item) * 0.1):
                    found[k] = d
        want[i, tuple(sorted(found)), min(found.values(), default=None)] += 1
    assert got == want
    more = decontaminate.matches(docs, bench, group_bytes=300, set_bytes=900)  # several sets
    assert Counter((r.doc_id, tuple(r.item_ids), r.least_distance) for r in more.collect()) == want
    clean = decontaminate.clean_documents(docs, bench, group_bytes=group_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(n for (_, ids, _), n in want.items() if not ids)
    assert {r.item_id for r in decontaminate.unsearched(bench).collect()} == {50, 51, 52, 60}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).where(F.size("item_ids") > 0).count() == 0


def test_short_items_and_null_ids(spark):
    items = [(1, "what is it?"), (2, "w"), (None, "an item without any id at all, long enough for edits")]
    texts = [(0, "So: WHAT  is it? Yes"), (1, "somewhat is it?"), (2, "w"), (3, "an item without any id at all, long enuogh for edits"), (4, "what is it"), (5, "what is it?s")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.least_distance) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {0: ([1], 0), 1: ([], None), 2: ([], None), 3: ([], 2), 4: ([], None), 5: ([], None)}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {1, 2, 4, 5}


def test_the_plan_does_not_grow_with_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 2000)
    rng = random.Random(1)
    items = [(i, sentence(rng, 20) + f" {i} {i * i}") for i in range(120)]
    docs = spark.createDataFrame([(i, "before " + items[i % 130][1] + " after" if i % 130 < 120 else "none") for i in range(260)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = decontaminate.matches(docs, bench), decontaminate.matches(docs, bench, group_bytes=1)
    plans = [df._jdf.queryExecution().toString() for df in (one, many)]
    assert [x.count("MapInArrow") for x in plans] == [plans[0].count("MapInArrow")] * 2 and abs(len(plans[0]) - len(plans[1])) < 200
    assert Counter(map(str, one.collect())) == Counter(map(str, many.collect()))
    assert one.where(F.size("item_ids") > 0).count() == 240


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_quality_on_held_out_rows(spark):
    """AUC, recall and calibration on rows whose labels were not learned."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").select("quality", "score", "predicted").collect()
    y, score = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert len(y) > 300 and auc(y, score) > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.95 and np.mean([r.predicted for r in rows if r.quality == 0]) < 0.1
    assert abs(score.mean() - y.mean()) < 0.03
    bins = np.minimum((score * 10).astype(int), 9)
    assert sum(abs(score[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(y) < 0.05


def test_temperature_calibrates():
    """Labels drawn with known probabilities: the fitted probabilities follow them and are not overconfident."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (6000, quality.FEATURES))
    truth = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(6000) < truth).astype(int)
    net = quality.fit(x[:3000], y[:3000])
    got, sharp = net.probabilities(x[3000:]), 1 / (1 + np.exp(-np.clip(net.logits(x[3000:]), -40, 40)))
    log_loss = lambda p: -np.mean(np.log(np.where(y[3000:] == 1, p, 1 - p) + 1e-12))
    assert net.temperature > 1 and log_loss(got) < log_loss(sharp)
    assert abs(got.mean() - y[3000:].mean()) < 0.05


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        words = rng.choices(WORDS + [f"w{rng.randrange(900)}" for _ in range(30)], k=rng.randrange(20, 120))
        junk = rng.choice([lambda w: w + "%%%", lambda w: " ".join([w] * 9), lambda w: w.upper() + "!!", lambda w: "| " + w])
        rows.append((i, " ".join(words if good else map(junk, words)), "x", 0.5))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "x", 0.1), (1001, "", "x", 0.1), (None, rows[1][1], "x", 0.1), rows[2], (1002, "word " * 60000, "x", 0.1)]
    labels += [(3, None, 0), (None, 1, 0), labels[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 12))
    assert by[None] == by[1] and len(by[2]) == 1
    # held-out labels have no influence on any score
    turned = known.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.repartition(5), turned).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in again) == Counter((r.doc_id, round(r.score, 6)) for r in got)
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.classify(docs.limit(20), known.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), known).count() == 0


def test_extendible_hashing(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(0, 900), 1, 2) for i in range(800)]
    rows += [(5, "y" * 700, 1, 2)] * 300 + [(None, "z" * 100, 1, 2)] * 3 + [(900, None, 1, 2), (901, "é" * 9000, 1, 2), (902, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, n int")
    limit = 6000
    got = extendible.shard(docs, limit, step=2).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", extendible.key_hash().alias("h")).distinct().collect()}
    shards = defaultdict(list)
    for r in got:
        assert hashes[r.doc_id] >> (60 - r.depth) == r.prefix
        shards[r.depth, r.prefix, r.page].append(r.n_bytes)
    assert all(sum(b) <= limit or len(b) == 1 for b in shards.values())
    for r in got:  # a bucket was only split where its parent was too large and could be split
        if r.depth:
            parent = [x for x in rows if hashes[x[0]] >> (61 - r.depth) == r.prefix >> 1]
            assert sum(size(x[1]) for x in parent) > limit and len({hashes[x[0]] for x in parent}) > 1
        own = [x for x in rows if hashes[x[0]] >> (60 - r.depth) == r.prefix]
        assert r.bucket_bytes == sum(size(x[1]) for x in own)
    assert max(r.page for r in got) > 30
    assert extendible.shard(docs.limit(0), limit).count() == 0


def test_license_scan(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "two words"), (3, licenses.TEMPLATES[0][1])]
    every_template = licenses.TEMPLATES + licenses.TEXTS
    for i in range(160):
        name, notice = rng.choice(every_template)
        tokens = notice.split()
        if i % 4 == 1:
            tokens[rng.randrange(len(tokens))] = "changed"
        if i % 4 == 2:
            tokens = tokens[: len(tokens) // 2]
        rows.append((10 + i, " ".join([sentence(rng, rng.randrange(0, 60)), *(tokens if i % 4 != 3 else []), sentence(rng, rng.randrange(0, 60))]).upper()))
    rows += [(11, rows[5][1]), (None, rows[6][1]), (600, "w " * 9000 + licenses.TEMPLATES[1][1] + " w" * 9000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, licenses string")
    got = Counter((r.doc_id, tuple(r.licenses), round(r.containment, 9)) for r in licenses.scan_licenses(docs).collect())
    want = Counter()
    for i, text in rows:
        every, found = licenses.shingles(licenses.words(text)), {}
        for name, notice in every_template:
            wanted = set(licenses.shingles(licenses.words(notice)))
            span = -(-5 * len(wanted) // 4)
            best = max((len(wanted & set(every[k : k + span])) for k in range(len(every))), default=0) / len(wanted)
            if best >= 0.8:
                found[name] = max(best, found.get(name, 0))
        want[i, tuple(sorted(found)), round(max(found.values(), default=0.0), 9)] += 1
    assert got == want and sum(bool(k[1]) for k in want) > 60
    assert licenses.scan_licenses(docs.limit(0)).count() == 0

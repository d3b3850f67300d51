"""The pipeline against its stages' rules, on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, simhash, sstable, systematic

from tests.llm.test_first_operators import slow_fingerprint, union_find


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, top = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    words = ["the", "and", "lore", "réa"] + [f"w{i}" for i in range(60)]
    item = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(30, 90)))
        text = text.upper().replace(" ", "!! ") if i % 6 == 0 else text + " " + item if i % 17 == 3 else text
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(300 + i, rows[i][1], "en", "s1", 1) for i in range(1, 40)] + [rows[5], (None, rows[7][1], "en", None, 2), (400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [k for k, _ in pipeline.STAGES][1] == "SimHash near-dedup"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.collect()
    kept = pipeline.keep_quality(spark, docs, sf_dir).cache()
    assert kept.columns == names
    clean = {r.doc_id for r in before if r.doc_id is not None and r.doc_id % 6 and r.doc_id < 300}
    left = {r.doc_id for r in kept.collect()}
    assert len(clean - left) <= 3 and len([i for i in left if i is not None and i < 300 and i % 6 == 0]) <= 3
    one = pipeline.drop_near_duplicates(spark, kept, sf_dir)
    rows = kept.collect()
    prints = [slow_fingerprint(r.text or "") for r in rows]
    roots = union_find(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    best = {}
    for i, r in enumerate(rows):
        place = (r.doc_id is None, r.doc_id or 0)
        best[roots[i]] = min(best.get(roots[i], (place, r)), (place, r), key=lambda x: x[0])
    assert one.columns == names and Counter(map(tuple, one.collect())) == Counter(tuple(r) for _, r in best.values())
    free = pipeline.drop_contaminated(spark, one, sf_dir)
    assert free.columns == names and {r.doc_id for r in one.collect()} - {r.doc_id for r in free.collect()} == {r.doc_id for r in one.collect() if r.doc_id is not None and r.doc_id % 17 == 3 and r.doc_id % 6}
    mixed = pipeline.mix_sources(spark, free, sf_dir)
    copies = {r.doc_id: r.copies for r in systematic.mix(free).collect() if r.copies}
    assert mixed.columns == names and Counter(r.doc_id for r in mixed.collect()) == copies
    out = pipeline.token_shards(spark, mixed, sf_dir)
    assert Counter(r.doc_id for r in out.collect()) == copies
    assert out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]
    again = pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))
    assert quality and decontaminate and simhash and sstable


def test_no_documents(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

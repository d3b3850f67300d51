"""Stages and operators that keep a table's columns: odd names, very long texts, empty and repeated rows."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, nearcopies, quality, systematic

ODD = ["a.b", "_t", "_score", "_k0", "_ids", "a`b", "Größe x", "_row", "item_ids"]
ITEM = "which of these words does the benchmark hold when it asks for one of them"
LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "a plain text of some words", "before " + ITEM + " after", LONG, LONG + "x", "WILD ### ???", "a plain text of some words"]
    rows = [(i if i != 3 else None, t, "en", f"s{i % 2}", 1, *(f"{n}{i}" for n in range(len(ODD)))) for i, t in enumerate(texts)]
    rows.append(rows[4])
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"c{k} string" for k in range(len(ODD)))).toDF(*names, *ODD)


STAGES = {
    "quality": lambda docs, labels, items: quality.keep_good(docs, labels, 0.0),
    "near copies": lambda docs, labels, items: nearcopies.keep_one(docs),
    "decontamination": lambda docs, labels, items: decontaminate.clean_documents(docs, items),
    "mix": lambda docs, labels, items: systematic.mixed_documents(docs),
}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_are_kept(spark, odd, stage):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 0), (6, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "no such thing in any of these texts")], "item_id long, text string")
    before = {tuple(r) for r in odd.collect()}
    out = STAGES[stage](odd, labels, items)
    assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
    rows = [tuple(r) for r in out.collect()]
    assert rows and set(rows) <= before
    ids = [r[0] for r in rows]
    if stage == "quality":
        assert len(rows) == odd.count()
    elif stage == "decontamination":
        assert 4 not in ids and len(rows) == odd.count() - 2
    elif stage == "near copies":
        assert ids.count(4) == 1 and (8 in ids) != (None in ids) and sum(i in ids for i in (0, 1, 2)) == 1
    empty = STAGES[stage](odd.where(F.lit(False)), labels, items)
    assert empty.columns == odd.columns and empty.count() == 0

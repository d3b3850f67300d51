"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads
them again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, nearcopies, quality, sstable, systematic
from tessera.llm.common import cleaned, drop_folder, materialize, table, work_uri
from tessera.llm.queries import word_tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this stage's own documents, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group linked by five-word Jaccard similarity of 0.8 or more."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return systematic.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token shards; a row per document as read back from them."""
    return sstable.read_shards(sstable.write_shards(docs, word_tokenizer()))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's working tables go once its rows are written, those of the last one stay."""
    docs, uri = table(spark, sf_dir, "documents"), work_uri(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with cleaned(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"{uri}/{k}")
        if k:
            drop_folder(spark, f"{uri}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the edit distance nor the tokenizer.
ORACLE_SQL = None

"""The operators' registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, extendible, licenses, matroska, quality, repeats, simhash, sstable, systematic, warc
from tessera.llm.common import materialize, table, work_uri

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.deduplicate_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_column_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), word_tokenizer()))


def op4_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumn("contaminated", F.col("least_distance").isNotNull())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shard(table(spark, sf_dir, "documents"), limit_bytes=1 << 20)


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic.mix(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(matroska.with_media(table(spark, sf_dir, "documents")), work_uri(spark, "media"))
    return matroska.payload_digests(media)


QUERIES: dict[str, Query] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_column_bwt_repeats": op2_column_bwt_repeats,
    "op3_sstable_tokens": op3_sstable_tokens,
    "op4_edit_decontamination": op4_edit_decontamination,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_extendible_shards": op7_extendible_shards,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_license_scan": op9_license_scan,
    "op10_matroska": op10_matroska,
}

ORACLE_SQL: dict[str, str] = {
    "op7_extendible_shards": r"""
WITH rows_ AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), every AS (
  SELECT doc_id, n_bytes, h, CAST(d AS INTEGER) AS d, h >> (60 - d) AS prefix FROM rows_, range(31) t(d)
), sums AS (
  SELECT d, prefix, CAST(sum(n_bytes) AS BIGINT) AS bucket_bytes FROM every GROUP BY d, prefix
  HAVING sum(n_bytes) <= 1048576 OR min(h) = max(h)
), placed AS (
  SELECT e.*, s.bucket_bytes, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.d) AS k
  FROM every e JOIN sums s ON e.d = s.d AND e.prefix = s.prefix
)
SELECT doc_id, n_bytes, d AS depth, prefix, CAST(0 AS BIGINT) AS page, bucket_bytes FROM placed WHERE k = 1
""",
    "op8_systematic_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k,
    CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w,
    source_size * CAST(2.0 AS DOUBLE) AS cap
  FROM sizes
), filled AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), goals AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w < cap THEN level END) OVER () * w, cap)) AS target,
    CAST(CAST('0x' || substr(md5('42:' || coalesce('s:' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) AS u
  FROM filled
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS rank FROM sized
), copied AS (
  SELECT r.doc_id, r.source, r.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN CAST(floor((rank + 1) * (g.target / g.source_size) + u) - floor(rank * (g.target / g.source_size) + u) AS BIGINT) ELSE 0 END AS copies
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT *, copies * size AS taken FROM copied
""",
}

"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, language, lattice, licenses, merkle, minhash, packing, resampling, sql, sstable, substrings, toxicity, warc
from .tokens import default_tokenizer

#: DuckDB SQL of the queries whose rows SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
               regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host,
               regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^#]*)', 1) AS rest FROM pages),
        k AS (SELECT *, coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END, '') AS url_key FROM p),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, row_number() OVER (ORDER BY url_key, page_id) - 1 AS capture_order FROM k)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, url_key, CAST(capture_order AS BIGINT) AS capture_order
        FROM q""",
    "op11_importance_resampling": sql.IMPORTANCE_RESAMPLING,
    "op12_substring_dedup": sql.SUBSTRING_DEDUP,
    "op13_merkle_manifest": sql.MERKLE_MANIFEST,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lattice.score(docs, *lattice.train(docs, lattice.default_vocabulary()))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(licenses.sample_lines(docs)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_order")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), default_tokenizer()))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_table(spark, sf_dir, "documents"), default_tokenizer())


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

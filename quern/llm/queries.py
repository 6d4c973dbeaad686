"""The queries of this subpackage over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontam, exact_dedup, langid, license_scan, secrets, sharding, simhash, token_rollup, warc
from quern.llm.shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(spark, sf_dir)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_notices(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_langid": op8_langid,
    "op9_secrets": op9_secrets,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.sql(),
    "op5_decontamination": decontam.SQL,
    "op9_secrets": secrets.sql(),
    "op3_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS copies, strlen(text) AS n_bytes
        FROM documents WHERE text IS NOT NULL WINDOW same AS (PARTITION BY text)
        UNION ALL
        SELECT doc_id, doc_id, 1, NULL FROM documents WHERE text IS NULL""",
}

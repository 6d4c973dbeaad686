"""The corpus pipeline: languages, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the rows
are a Parquet table in the shared folder.  All but the last return the columns of documents.

Null and empty texts have no language and go in the first stage.  Of exact and near copies the row of the lowest doc_id stays, a null one only
where there is no other; repeated rows are copies.  Other columns are carried on and don't count.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontam, exact_dedup, langid, simhash
from quern.llm.shared import bounded, kept, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language claims."""
    bounded(spark)
    return langid.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    bounded(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    bounded(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark and without its rare words close together."""
    bounded(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    bounded(spark)
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's working tables go once its rows are stored
            docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, token ids.

Every stage gets all rows that its predecessor kept and all but the last return the columns of
``documents``.  Near duplicates keep the smallest doc_id of each component; secrets are replaced in
the text; mixing draws documents by calibrated probabilities; the last stage adds each text's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightwell.llm import bpe, common, jaccard, mixing, quality, secrets

#: The token models and the forest are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing to target weights", mixing_to_targets),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, "stage")
    return docs

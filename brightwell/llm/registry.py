"""The queries of the training-data operators and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, jaccard, language, licenses, mixing, quality, secrets, shards, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_language": language.op3_language,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_bpe": bpe.op5_bpe,
        "op6_mixing": mixing.op6_mixing,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_secrets": secrets.op8_secrets,
        "op9_quality": quality.op9_quality,
        "op10_shards": shards.op10_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op6_mixing": mixing.ORACLE, "op7_jaccard": jaccard.ORACLE}

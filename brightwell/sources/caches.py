"""Model results kept as tables, keyed by what they were made from, and the default embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMENSIONS = 64


def keyed(texts: DataFrame, text: str, backend: str, model: str, *more: str) -> DataFrame:
    """Distinct ``key, text`` and ``more`` columns, which also enter the key (a question, for pair scores)."""
    key = T.cache_key(F.lit(backend), F.lit(model), *[F.col(m) for m in more], F.col(text))
    return texts.filter(F.col(text).isNotNull()).select(key.alias("key"), *more, F.col(text).alias("text")).dropDuplicates(["key"])


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What is asked for and not in the cache, each once."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def filled(wanted: DataFrame, cache: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, value`` for all of ``wanted``: from the cache, else from ``make`` (``key, text`` to ``key, value``), which sees each text once."""
    made = make(misses(wanted, cache)).select("key", "value")
    return wanted.select("key").join(cache.select("key", "value").unionByName(made), "key")


def append(made: DataFrame, path: str) -> None:
    made.select("key", "value").write.mode("append").parquet(path)


def term_buckets(texts: DataFrame, id: str, text: str) -> DataFrame:
    """``id, b, n``: words of a text by hash bucket."""
    words = texts.select(id, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return words.groupBy(id, (F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("bigint") % DIMENSIONS).alias("b")).agg(F.count("*").alias("n"))


def embedded(texts: DataFrame, id: str, text: str) -> DataFrame:
    """Default embedder: ``id, embedding`` of unit length over the hash buckets; a text without a word has zeros."""
    b = term_buckets(texts, id, text).groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("b", F.col("n").cast("double")))).alias("m"))
    zeros = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(DIMENSIONS - 1).cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return texts.select(id).distinct().join(b, id, "left").select(id, T.unit(zeros).alias("embedding"))

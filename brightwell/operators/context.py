"""Serialising selected evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped(selected: DataFrame) -> DataFrame:
    """``[title]`` and its sentences in document order, passages in document order."""
    p = selected.groupBy("qid", "passage_ord", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "text"))), lambda x: x["text"]), "\n").alias("body"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("passage_ord", "title", "body"))), lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["body"]))
    return p.groupBy("qid").agg(F.array_join(lines, "\n").alias("context"))


def numbered(selected: DataFrame) -> DataFrame:
    """``[Evidence i | title]`` in selection order."""
    items = F.array_sort(F.collect_list(F.struct("sel", "title", "text")))
    line = lambda x, i: F.concat(F.lit("[Evidence "), (i + 1).cast("string"), F.lit(" | "), x["title"], F.lit("]\n"), x["text"])
    return selected.groupBy("qid").agg(F.array_join(F.transform(items, line), "\n").alias("context"))


def compact(selected: DataFrame) -> DataFrame:
    """Selection order; a header only where the title changes."""
    before = F.lag("title").over(W.partitionBy("qid").orderBy("sel"))
    rows = selected.withColumn("line", F.when(before.isNull() | (before != F.col("title")), F.concat(F.lit("["), "title", F.lit("]\n"), "text")).otherwise(F.col("text")))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sel", "line"))), lambda x: x["line"]), "\n").alias("context"))

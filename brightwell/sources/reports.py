"""Sinks for results: JSON lines, CSV, run metadata, Markdown tables and the data of trade-off figures.

Rows are written by the executors; only aggregates (a row for each method and budget) reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of an aggregate that a report renders at most; beyond it the table belongs in a file.
MAX_REPORT_ROWS = 10_000


def append_rows(rows: DataFrame, path: str, by: Sequence[str] = ("method",)) -> None:
    rows.write.mode("append").partitionBy(*by).option("ignoreNullFields", "false").json(path)


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines of one or more files; blank lines give no row."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header; meant for aggregates."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def union_of_keys(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns, absent ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_metadata(spark: SparkSession, path: str, **values: object) -> None:
    """Run metadata as one JSON text in the folder ``path``."""
    text = json.dumps(values, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fmt(value: object, digits: int = 4) -> str:
    return "" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(rows: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> str:
    """A Markdown table of an aggregate, in its own order; numbers are right-aligned."""
    names = list(columns or rows.columns)
    kinds = dict(rows.dtypes)
    found = rows.select(*names).take(MAX_REPORT_ROWS + 1)
    if len(found) > MAX_REPORT_ROWS:
        raise ValueError(f"more than {MAX_REPORT_ROWS} rows; write a file instead")
    lines = ["| " + " | ".join(names) + " |", "|" + "|".join("---" if kinds[n] == "string" else "---:" for n in names) + "|"]
    lines += ["| " + " | ".join(fmt(r[n], digits) for n in names) + " |" for r in found]
    return "\n".join(lines) + "\n"


def trade_off(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points of each ``method`` with ``frontier``: whether no point of any method costs less or the same and gains more."""
    best = F.max(gain).over(W.orderBy(F.asc(cost)).rangeBetween(W.unboundedPreceding, 0))
    return points.withColumn("frontier", F.col(gain) >= best)

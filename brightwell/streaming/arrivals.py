"""Scoring arriving questions with Structured Streaming; finished keys are skipped like in a resumed run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import multihop


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append ``plan``'s rows for each micro-batch to ``out`` (Parquet), without those already there."""

    def batch(df: DataFrame, _: int) -> None:
        rows = plan(df)
        spark = df.sparkSession
        try:
            done = spark.read.parquet(out)
        except Exception:  # noqa: BLE001 - nothing written yet
            done = None
        (rows if done is None else multihop.pending(rows, done, key)).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

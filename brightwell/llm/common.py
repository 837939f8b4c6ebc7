"""Shared plumbing of the training-data operators: table access, bounded Arrow batches, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; with texts of a few kB a batch is a few MB.
BATCH_ROWS = 512
#: Side tables up to this many rows (of a few dozen bytes) may be broadcast; larger ones are shuffle-joined.
BROADCAST_ROWS = 200_000
#: The same for tables of one id of 8 bytes (some 64 MB as a hash table).
BROADCAST_IDS = 2_000_000
#: Bytes of one Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows (and bytes, where Spark knows that setting) of each Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_MODEL: dict[tuple, object] = {}


def model(key: tuple, make: Callable[[], object]) -> object:
    """The vocabulary or model of a worker process, made once; another one's first use frees the one before.

    Workers outlive a stage, and stages of several operators follow each other in them.
    """
    if key not in _MODEL:
        if _MODEL:
            _MODEL.clear()
            gc.collect()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
        _MODEL[key] = make()
    return _MODEL[key]


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[list]], schema: str) -> DataFrame:
    """``mapInArrow`` over column lists.

    ``fn`` gets an iterator of batches as ``{column: python list}`` and yields, for each output
    batch, a list of column values in the order of ``schema``.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict[str, list]]:
            for b in batches:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(names)}

        for cols in fn(lists()):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the cluster names none, as in tests, a folder under the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/brightwell-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t", options: dict[str, str] | None = None, reclaim: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of any executor.  ``reclaim``, for jobs with
    large shuffles, lets the driver's collector find at once that nothing uses their files.  The
    table stays until ``discard`` or the end of a ``scope``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}-{name}"
    df.write.options(**(options or {})).parquet(path)
    if reclaim:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return out


_SCOPES: list[list[tuple[SparkSession, str]]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete a ``written`` table that no plan needs any more."""
    _delete(table.sparkSession, table.scratch_path)


@contextmanager
def scope(*kept: str) -> Iterator[None]:
    """At its end the tables written inside are deleted, but those with a name in ``kept``: the result's own."""
    mine: list[tuple[SparkSession, str]] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for spark, path in mine:
            if path.rsplit("-", 1)[-1] in kept:
                if _SCOPES:
                    _SCOPES[-1].append((spark, path))
            else:
                _delete(spark, path)


def joined(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None, most: int | None = None) -> DataFrame:
    """Join that broadcasts ``small`` only if its counted rows are within ``most`` (else ``BROADCAST_ROWS``)."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= (BROADCAST_ROWS if most is None else most) else small, on, how)

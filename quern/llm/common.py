"""Shared plumbing of the training-data operators: shared-folder tables, Arrow batches, sorted groups."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quern.session import importable, new_folder, remove

#: Rows that an operator works on at once.
BATCH_ROWS = 1000
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package."""
    return importable(spark)


@contextmanager
def small_batches(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs in this block send Python workers batch_rows rows at once, and drop their shuffle files when they end; then the session's settings are as before."""
    rows = int(spark.conf.get(_BATCH))
    own = {_CLEANUP: "true", _BATCH: str(min(rows, batch_rows) if rows > 0 else batch_rows)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, *gone: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again. It survives lost executors.

    gone: tables of earlier calls that only df was made from; they are deleted when the new table is whole, as its shuffle files are.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    for table in gone:
        remove(spark, table._shared_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


_kept: dict = {}


def kept(key: object, make: Callable) -> object:
    """make(), once in a worker as long as nothing else is asked for: what an operator keeps goes when the worker goes on to another one."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType) -> DataFrame:
    """One output batch for each BATCH_ROWS rows of an input batch."""
    return df.mapInArrow(_Each(fn), schema)


class _Each:
    def __init__(self, fn: Callable) -> None:
        self.fn = fn

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                out = self.fn(whole.slice(at, BATCH_ROWS))
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each span (start, end) overlaps none of the taken ones."""
    starts, reach = [], []
    for a, b in sorted(taken):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    return [(i := bisect_left(starts, b)) == 0 or reach[i - 1] <= a for a, b in spans]

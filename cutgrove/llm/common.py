"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cutgrove.session import cut

__all__ = ["cut", "lean", "parts", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that Spark hands to a Python worker at once while a step runs that holds much beside its texts (the default is 10,000).
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of at most BATCH_ROWS rows for what is computed inside the block; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@lru_cache(maxsize=1)
def _trim() -> Callable:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return lambda _: 0


def lean(run: Callable) -> Callable:
    """The same map over batches; after each partition the worker gives freed memory back, as Spark keeps idle workers."""

    def go(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return go

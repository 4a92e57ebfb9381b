"""Small shared pieces: text normalisation, batches, tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROWS_AT_ONCE, BYTES_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Jobs started inside exchange at most so many rows and bytes at a time with Python, which
    bounds what a task holds of wide rows; the session's own settings come back afterwards."""
    before = {name: spark.conf.get(name) for name in (ROWS_AT_ONCE, BYTES_AT_ONCE)}
    spark.conf.set(ROWS_AT_ONCE, rows)
    spark.conf.set(BYTES_AT_ONCE, size)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def release() -> None:
    """Give memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(step: Callable) -> Callable:
    """A step over batches whose worker holds no freed memory while it waits for the next task, up to a minute
    and beside the executor's next stage."""
    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch], *rest) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches, *rest)
        finally:
            release()

    return run


def released_group(step: Callable) -> Callable:
    """The same for a step over one group."""
    @functools.wraps(step)
    def run(table: pa.Table, *rest) -> pa.Table:
        try:
            return step(table, *rest)
        finally:
            release()

    return run

"""Intermediate tables of one operator below the shared folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardlake.session import delete_path, scratch_path


class Scratch:
    """Writes intermediate tables where every executor can read them again.

    A written table cuts the lineage: a lost executor costs the tasks that ran
    on it, never the stages before. ``drop`` removes a table as soon as a later
    one holds all that is needed of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"llm-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While this is open, whole texts go to Python ``rows`` at a time. For jobs that run inside, as those of `Scratch` do."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run: Callable) -> Callable:
    """``run`` over batches; when a task is done, its process gives back the memory that it needs no more."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def tidy_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """As `tidy`, for a function of a key and its group: memory goes back after each group."""

    def inner(key: tuple, rows: pa.Table) -> pa.Table:
        try:
            return run(key, rows)
        finally:
            _give_back()

    return inner


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that has it
    if trim is not None:
        trim(0)

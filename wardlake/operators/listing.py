"""Filters, search and pages of registry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.session import written

# Page sizes.
PAGE_SIZE = 20
JOB_PAGE_SIZE = 10
MESSAGE_PAGE_SIZE = 50
RECENT = 5
# Rows before a page from which on ranges are counted instead of sorting all of them to one task.
DEEP = 10_000


def where_equal(df: DataFrame, **values: str | None) -> DataFrame:
    """Equality filters; an empty or missing value filters nothing."""
    for name, value in values.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where some column contains ``text``, whatever the case; blank finds all."""
    if not text.strip():
        return df
    wanted = text.lower()
    hits = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(wanted) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def page(df: DataFrame, newest_first: list[Column], limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """One page of the size asked for, plus the ``total`` number of rows it is a page of."""
    if limit < 1 or offset < 0:
        raise ValueError(f"no page has limit {limit} and offset {offset}")
    if offset >= DEEP:
        return deep_page(df, newest_first, limit, offset)
    total = df.agg(F.count("*").alias("n"))
    rows = df.orderBy(*newest_first).offset(offset).limit(limit)
    return rows.withColumn("total", total.scalar())


def deep_page(df: DataFrame, newest_first: list[Column], limit: int, offset: int) -> DataFrame:
    """The same page, of which no task sees more than a range of the rows.

    Rows are dealt into ordered ranges and written. The ranges' counts (one
    number per range) say in which the page lies; only those are sorted, and only rows of
    the page leave them. Rows that are equal in the order are told apart by where they were read.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(ranges, *newest_first, "_place").withColumn("_range", F.spark_partition_id())
    rows = written(dealt, "page")
    before, chosen = 0, []
    for r in rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        if before < offset + limit and before + r["n"] > offset:
            chosen.append((r["_range"], before))
        before += r["n"]
    starts = F.lit(0)
    for part, first in chosen:
        starts = F.when(F.col("_range") == part, F.lit(first)).otherwise(starts)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*newest_first, "_place")) + starts
    held = rows.where(F.col("_range").isin([part for part, _ in chosen])).withColumn("_rank", rank)
    shown = held.where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).orderBy("_rank")
    return shown.select(*df.columns, F.lit(before).cast("long").alias("total"))


def recent(df: DataFrame, newest_first: list[Column], count: int = RECENT) -> DataFrame:
    return df.orderBy(*newest_first).limit(count)

"""Contiguous balanced shards from global prefix sums of byte sizes.

Rows are dealt into ordered ranges and written once. Each range's total is known
before any row gets its offset, so no task ever sees more than one range. The
cut points are equal shares of the total; a row belongs to the shard in which
the middle of its bytes lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.scratch import Scratch, partitions


def prefix_sums(rows: DataFrame, order: list[Column], weight: str) -> DataFrame:
    """``rows`` with ``row_before`` and ``weight_before``, what precedes each row in the whole order, and ``weight_total``.

    ``weight`` names a non-negative long column. Equal rows are ordered by
    where they were read, so any number of them spreads over ranges.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    named = [c.alias(f"order_{i}") for i, c in enumerate(order)] + [F.monotonically_increasing_id().alias(f"order_{len(order)}")]
    keys = [f"order_{i}" for i in range(len(named))]
    dealt = rows.select(F.struct("*").alias("row"), F.col(weight).cast("long").alias("w"), *named)
    ranges = Scratch(spark).keep(
        "ranges", dealt.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    )
    totals = ranges.groupBy("part").agg(F.count("*").alias("rows"), F.sum("w").alias("bytes"))
    # One row per range, not per document.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("weight_total"),
    )
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumn("n", F.count("*").over(inside)).withColumn("b", F.coalesce(F.sum("w").over(inside), F.lit(0)))
    return local.join(starts, "part").select(
        "row.*",
        (F.col("n") + F.col("rows_before")).alias("row_before"),
        (F.col("b") + F.col("bytes_before")).alias("weight_before"),
        "weight_total",
    )


def shards(documents: DataFrame, n_shards: int, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: ``n_shards`` contiguous shards of near equal bytes.

    ``size`` is the text's UTF-8 length (none for null) plus ``overhead`` bytes.
    The order is that of checksum, size and id, so equal texts are neighbours;
    repeated rows each get a slot. Shards differ from an equal share by less
    than the two texts at their ends, and ``slot`` runs from 0 without gaps.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = prefix_sums(rows, [F.col("text_crc32"), F.col("size"), F.col("doc_id")], "size")
    middle = F.expr(f"((weight_before * 2 + size) * {n_shards}) div (weight_total * 2)")
    cut = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    first = cut.groupBy("shard").agg(F.min("row_before").alias("first"))  # a row per shard
    return cut.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_before") - F.col("first")).alias("slot")
    )

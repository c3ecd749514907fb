"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside groups.

Three narrow steps, built-in functions only:

1. Every row becomes an id, its place and a digest; the digest's first 128 bits
   are the content hash. Groups are counted with map-side sums, so a text that
   holds a third of all rows sends one row per task.
2. Texts travel only where a hash repeats. A bitmap of fixed size (at most
   ``SLOTS`` bits, 8 MB, whatever the input) says which hashes may, and is all
   that is broadcast for it. Equal texts are folded before the shuffle, and a
   hash with two different texts is a collision.
3. Rows take their group's answer. Groups of more than a ``HOT``-th of all rows
   are fewer than ``HOT`` by count and are broadcast; the others are joined by hash.
   Rows of collided hashes are grouped by their bytes instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.scratch import Scratch

SLOTS = 1 << 26
HOT = 1_000


def content_hash(text: Column) -> Column:
    """The first 128 bits of the text's SHA-256, as bytes."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _slot(hashed: Column) -> Column:
    return F.pmod(F.xxhash64(hashed), F.lit(SLOTS)) + 1


def bitmap_of(hashes: DataFrame) -> DataFrame:
    """``bucket, bits``: at most ``SLOTS`` / 32,768 rows of 4 KB, a bit for each slot that ``hash`` takes."""
    return hashes.groupBy(F.bitmap_bucket_number(_slot(F.col("hash"))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_slot(F.col("hash")))).alias("bits")
    )


def among(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows whose ``hash`` has its bit set."""
    at = F.bitmap_bit_position(_slot(F.col("hash")))
    byte = F.conv(F.hex(F.substr(F.col("bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number(_slot(F.col("hash")))).join(F.broadcast(bitmap), "bucket")
    return found.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("bucket", "bits")


def exact_groups(
    documents: DataFrame,
    normalise: Callable[[Column], Column] = lambda text: text,
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, in groups of equal texts.

    Texts are equal when their bytes are after ``normalise`` (nothing by
    default); null is the empty text. In each group the row with the largest
    id stays. A null id is less than any other; of rows that repeat both id and
    text one stays, and ``kept`` is true once per group. Texts of any length are
    hashed and compared whole. Other columns are ignored, whatever their names;
    an empty table gives no rows. ``hashed`` decides only how rows meet: with
    any function of the text the result is the same.
    """
    scratch = Scratch(documents.sparkSession)
    whole = F.coalesce(normalise(F.col("text")), F.lit(""))
    texts = documents.select("doc_id", whole.alias("text"))
    rows = scratch.keep(
        "rows",
        texts.select(
            "doc_id",
            F.monotonically_increasing_id().alias("place"),
            hashed(F.col("text")).alias("hash"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        ),
    )
    answer = [
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.coalesce(F.max_by("place", "doc_id"), F.max("place")).alias("keep_place"),
    ]
    # Written, so that a tie between repeated rows is settled once.
    groups = scratch.keep("groups", rows.groupBy("hash").agg(*answer).where("group_size > 1"))
    hashes = texts.select(hashed(F.col("text")).alias("hash"), "text")
    bitmap = scratch.keep("bitmap", bitmap_of(groups))
    variants = among(hashes, bitmap).groupBy("hash", "text").agg(F.count("*").alias("n"))
    collided = scratch.keep("collided", variants.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"))
    alone = [
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.col("place").alias("keep_place"),
    ]
    plain, settled = rows, groups
    if clash := not collided.isEmpty():
        plain, settled = rows.join(collided, "hash", "left_anti"), groups.join(collided, "hash", "left_anti")
    n = rows.count()
    hot = settled.where(F.col("group_size") * HOT > n)  # fewer than HOT groups
    cold = settled.where(F.col("group_size") * HOT <= n)
    marked = plain.join(F.broadcast(hot), "hash", "left")
    rest = marked.where("group_size IS NULL").select("hash", "doc_id", "place", "digest").join(cold, "hash", "left")
    single = F.col("group_size").isNull()
    rest = rest.select(
        "doc_id", "place", "digest",
        *(F.when(single, a).otherwise(F.col(c)).alias(c) for a, c in zip(alone, ("keep_id", "group_size", "keep_place"), strict=True)),
    )
    columns = ["doc_id", "place", "digest", "keep_id", "group_size", "keep_place"]
    result = marked.where("group_size IS NOT NULL").select(columns).union(rest.select(columns))
    if clash:
        result = result.union(_by_bytes(texts, collided, hashed, answer, scratch).select(columns))
    return result.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_bytes(texts: DataFrame, collided: DataFrame, hashed, answer: list[Column], scratch: Scratch) -> DataFrame:
    """The rows of collided hashes, grouped by their bytes."""
    marked = texts.withColumn("hash", hashed(F.col("text"))).join(collided, "hash", "left_semi")
    rows = scratch.keep("clashing", marked.withColumn("place", F.monotonically_increasing_id()))
    groups = scratch.keep("apart", rows.groupBy("hash", "text").agg(*answer))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    return rows.join(groups, ["hash", "text"]).select("*", digest)


def distinct_texts(documents: DataFrame, normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """``documents`` with one whole row of each group of equal texts, that with the largest id; columns as they were.

    Of rows that repeat id and text, the one with the largest hash of its other
    columns stays. Null ids come last, null texts are empty texts.
    """
    whole = F.coalesce(normalise(F.col("text")), F.lit(""))
    others = [f.name for f in documents.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64(F.col("text").isNull(), *others))
    rows = documents.select(content_hash(whole).alias("hash"), whole.alias("whole"), F.struct("*").alias("row"), order.alias("order"))
    best = rows.groupBy("hash", "whole").agg(F.max_by("row", "order").alias("row"))
    return best.select("row.*")

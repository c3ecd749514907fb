"""Benchmark decontamination: short items found inside long documents.

Minwise containment search with size partitions. Items are partitioned by the
size of their shingle set; a partition with sets of up to ``u`` shingles keeps
the ``u - ceil(t u) + 1`` smallest shingle hashes of each item (its bottom-k
MinHash). A document that holds the share ``t`` of an item holds one of those at
least, whatever the document's length, so the search loses nothing. A document
too small for an item's share is no candidate. Candidates are then verified on
the shingles themselves. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5  # five words, a share of 4/5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(words: Column, made, width: int) -> Column:
    n = F.size(words)
    return (
        F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: made(F.slice(words, i, width))))
        .when(n > 0, F.array(made(words)))
        .otherwise(F.array().cast("array<string>" if made is _spelled else "array<bigint>"))
    )


def _spelled(words: Column) -> Column:
    return F.array_join(words, " ")


def _hashed(words: Column) -> Column:
    return F.xxhash64(words)


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    return _shingles(words, _hashed, width)


def shingle_texts(words: Column, width: int = WIDTH) -> Column:
    """Distinct shingles; a text of fewer words is one shingle, one without words has none."""
    return F.array_distinct(_shingles(words, _spelled, width))


def _tie(text: Column) -> Column:
    """Tells rows of one id apart (null is an id)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, item_tie, size, need, hash``: a row for each smallest hash of each item."""
    sets = benchmark.select("item_id", _tie(F.col("text")).alias("item_tie"), words(F.col("text")).alias("words")).where(F.size("words") > 0).select(
        "item_id", "item_tie", F.sort_array(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("hashes")
    )
    sized = sets.select("item_id", "item_tie", "hashes", F.size("hashes").alias("size"))
    partition = sized.withColumn("upper", F.expr("cast(pow(2, floor(log2(size)) + 1) AS int) - 1"))
    need = f"(size * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR}"
    kept = f"upper - (upper * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR} + 1"
    return partition.select(
        "item_id",
        "item_tie",
        "size",
        F.expr(need).cast("int").alias("need"),
        F.explode(F.slice("hashes", F.lit(1), F.expr(kept).cast("int"))).alias("hash"),
    )


def candidates(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, tie, item_id, item_tie`` of every text that shares a signature hash with an item and is large enough for it."""
    split = documents.select("doc_id", _tie(F.col("text")).alias("tie"), words(F.col("text")).alias("words"))
    hashed = split.select(
        "doc_id", "tie", F.size("words").alias("n_words"), F.explode(shingle_hashes(F.col("words"), width)).alias("hash")
    )
    large_enough = F.greatest(F.col("n_words") - (width - 1), F.lit(1)) >= F.col("need")
    found = hashed.join(signatures(benchmark, width), "hash").where(large_enough)
    return found.select("doc_id", "tie", "item_id", "item_tie").distinct()


def _held(documents: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """``doc_id, tie, item_id, shared, size`` of every text and item it holds; one id can have several of both."""
    pairs = candidates(documents, benchmark, width)
    items = benchmark.select(
        F.col("item_id").alias("of_item"), _tie(F.col("text")).alias("of_item_tie"), words(F.col("text")).alias("item_words")
    )
    texts = documents.select(F.col("doc_id").alias("of_doc"), _tie(F.col("text")).alias("of_tie"), F.col("text").alias("of_text"))
    held = (
        pairs.join(items, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_tie") == F.col("of_item_tie")))
        .join(texts, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tie") == F.col("of_tie")))
        .select("doc_id", "tie", "item_id", "item_tie", "item_words", words(F.col("of_text")).alias("words"))
        .select(
            "doc_id",
            "tie",
            "item_id",
            "item_tie",
            shingle_texts(F.col("item_words"), width).alias("wanted"),
            shingle_texts(F.col("words"), width).alias("there"),
        )
        .select(
            "doc_id", "tie", "item_id", "item_tie",
            F.size("wanted").alias("size"), F.size(F.array_intersect("wanted", "there")).alias("shared"),
        )
    )
    # The share is tested on the grouped rows: a condition on ``held`` itself would move
    # into the join and take the words apart again for each shingle.
    each = held.groupBy("doc_id", "tie", "item_id", "item_tie").agg(F.max("shared").alias("shared"), F.max("size").alias("size"))
    return each.where(F.col("shared") * DENOMINATOR >= F.col("size") * NUMERATOR).select("doc_id", "tie", "item_id", "shared", "size")


def contained_items(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment``: every item of which a document holds 4/5 or more.

    Sizes are of distinct shingles of ``width`` words; a text of fewer words is
    one shingle; texts that are null or without words hold nothing and are held
    by nothing. Rows that repeat an id (null is an id) are judged one by one; an
    item counts once per id, with the largest share. Other columns are ignored.
    """
    share = F.struct((F.col("shared") / F.col("size")).alias("share"), "shared", "size")
    best = _held(documents, benchmark, width).groupBy("doc_id", "item_id").agg(F.max(share).alias("best"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.size").cast("long").alias("n_shingles"),
        F.col("best.shared").cast("long").alias("n_shared"),
        F.col("best.share").alias("containment"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` without the rows that hold an item, columns as they were; other rows of their id stay."""
    hit = _held(documents, benchmark, width).select(F.col("doc_id").alias("of_doc"), F.col("tie").alias("of_tie")).distinct()
    same = documents["doc_id"].eqNullSafe(hit["of_doc"]) & (_tie(documents["text"]) == hit["of_tie"])
    return documents.join(hit, same, "left_anti")

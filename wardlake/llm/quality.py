"""Quality classifier by importance resampling of hashed n-grams.

Two bags of hashed n-grams are counted: that of the target (labelled good text)
and that of raw text (all labelled text, good or not; copies of one unlabelled
text, however many, do not make its words look bad). The log ratio of the two
models says how much less than raw text the target has of an n-gram. A
document's importance is the product of these ratios, each at most one: it is as
important as its least target-like n-grams allow, and ordinary n-grams, however
many, make up for nothing. Its logarithm is divided by the root of the length,
with which the chance part of such a sum grows. All documents are then drawn
from without replacement, by Gumbel top-k on their log importance. ``k`` is the
number of documents whose importance passes a cut.

The cut is set on the labelled documents of both classes. Each is scored by the models
without its own n-grams, so none speaks for itself: of the cuts that let go at
most ``ALLOWED`` of the good, that which stops most of the others, and of equal
ones the lowest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import vec
from wardlake.llm.scratch import Scratch, tidy
from wardlake.llm.shard import prefix_sums

SLOTS = 1 << 21  # of each model, whatever the input
BLOCKS = 32
PRIOR = 2.0  # occurrences that both models agree on before any is counted
IGNORED = 1.0  # log ratios above minus this are ordinary
USUAL = 1000  # bytes at which log importance is taken as it is
SHORT = 200  # bytes below which a text counts as this long
SHARPNESS = 4.0  # of the draw: log importance against the Gumbel noise
LABELLED = 100_000  # most labelled documents the target and the cut are learned from
ALLOWED = 0.005  # share of labelled good documents the cut may lose


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and rows of all n-grams: words, pairs of words, beginnings and endings of words."""
    start, end, row = vec.words(buf, off)
    if not len(start):
        return np.zeros(0, np.int64), row
    plain, lower = vec.prefix(buf), vec.prefix(vec.LOWER[buf])
    size = end - start
    word, low = vec.span(plain, start, end), vec.span(lower, start, end)
    parts, rows = [word, low + np.uint64(1)], [row, row]
    for n in (3, 4, 5):
        own = size > n
        parts.append(vec.span(lower, start[own], start[own] + n) + np.uint64(10 + n))
        rows.append(row[own])
    for n in (1, 2):
        own = size > n
        parts.append(vec.span(plain, end[own] - n, end[own]) + np.uint64(20 + n))
        rows.append(row[own])
    pair = np.flatnonzero(row[1:] == row[:-1])
    again = low[pair] == low[pair + 1]
    both = vec.mix(low[pair] * np.uint64(0x9FB21C651E98DF25) + low[pair + 1])
    parts.append(np.where(again, np.uint64(31), both))
    rows.append(row[pair])
    slot = (vec.mix(np.concatenate(parts)) & np.uint64(SLOTS - 1)).astype(np.int64)
    return slot, np.concatenate(rows)


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, b, o in vec.pieces(*vec.utf8(batch.column(0))):
            counts += np.bincount(ngrams(b, o)[0], minlength=SLOTS)
    packed = [zstandard.compress(x.astype(np.uint32).tobytes() if x.max(initial=0) < 1 << 32 else x.tobytes(), 1) for x in np.split(counts, BLOCKS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def _sum(blocks: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS // BLOCKS, np.int64)
    for x in blocks["counts"]:
        raw = zstandard.decompress(x.as_py())
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.int64).astype(np.int64)
    return pa.table({"block": blocks["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def bag(texts: DataFrame) -> np.ndarray:
    """Occurrences of each slot in all ``text``."""
    schema = "block int, counts binary"
    out = np.zeros(SLOTS, np.int64)
    for row in texts.select("text").mapInArrow(tidy(_bag), schema).groupBy("block").applyInArrow(_sum, schema).collect():  # BLOCKS rows
        out.reshape(BLOCKS, -1)[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out


def _evidence(target, raw, share: float, usual: float):
    """Log ratio of the models where they saw an n-gram so often; ordinary ones are 0, and none is positive."""
    found = np.log((target + PRIOR) / (raw * share + PRIOR)) - usual
    return np.where(found < -IGNORED, found, 0.0)


def levels(target: np.ndarray, raw: np.ndarray) -> tuple[float, float]:
    """Size of the target to that of the raw text, and the log ratio that is usual in the target."""
    share = target.sum() / max(1, raw.sum())
    found = np.log((target + PRIOR) / (raw * share + PRIOR))
    return float(share), float(np.average(found, weights=target)) if target.sum() else 0.0


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The evidence of each slot."""
    return _evidence(target, raw, *levels(target, raw)).astype(np.float32)


def _scaled(score: np.ndarray, off: np.ndarray) -> np.ndarray:
    return score / np.sqrt(np.maximum(np.diff(off), SHORT) / USUAL)


def importance(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log importance of each row: 0 for an ordinary text, lower for others. Repeats of an n-gram count."""
    out = np.zeros(len(off) - 1)
    for low, high, b, o in vec.pieces(buf, off):
        slot, row = ngrams(b, o)
        out[low:high] = np.bincount(row, weights=table[slot], minlength=high - low)
    return _scaled(out, off)


def importance_without(buf: np.ndarray, off: np.ndarray, good: np.ndarray, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log importance of labelled rows, each by the models without its own n-grams."""
    out, known = np.zeros(len(off) - 1), levels(target, raw)
    for low, high, b, o in vec.pieces(buf, off):
        slot, row = ngrams(b, o)
        both, n = np.unique(row.astype(np.int64) * SLOTS + slot, return_counts=True)
        row, slot = np.divmod(both, SLOTS)
        found = _evidence(target[slot] - n * good[low:high][row], raw[slot] - n, *known)
        out[low:high] = np.bincount(row, weights=found * n, minlength=high - low)
    return _scaled(out, off)


def best_cut(good: np.ndarray, others: np.ndarray) -> float:
    """The score below which at most ``ALLOWED`` of the good lie (one at least may) and most of the others; the lowest such."""
    if not len(good):
        return float("-inf")
    first = np.sort(good)[: int(np.ceil(ALLOWED * len(good))) + 1]
    stopped = np.searchsorted(np.sort(others), first, side="left")
    return float(first[int(np.argmax(stopped))])


def gumbel(ids: np.ndarray, ties: np.ndarray, seed: int) -> np.ndarray:
    """Noise of each row, the same in every run."""
    mixed = vec.mix(vec.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ ties.view(np.uint64))
    u = (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return -np.log(-np.log(u))


def _keys(table, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = vec.utf8(batch.column(2))
            score = importance(buf, off, table.value)
            noise = gumbel(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(SHARPNESS * score + noise)], ["doc_id", "score", "key"])

    return run


def _left_out(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            score = importance_without(*vec.utf8(batch.column("text")), good, *models.value)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(score)], ["good", "score"])

    return run


class Classifier:
    """Learned once from a bounded number of labelled documents."""

    def __init__(self, documents: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = 1):
        self.seed, self.spark = seed, documents.sparkSession
        known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
        # Any order that does not look at the rows will do; ``most`` bounds the sample.
        chosen = known.select(F.col("doc_id").alias("of_doc"), good.alias("good")).orderBy(F.xxhash64("of_doc")).limit(most)
        # At most ``most`` ids and flags are broadcast.
        sample = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of_doc"))
        scratch = Scratch(self.spark)
        sample = scratch.keep("labelled", sample.select("doc_id", "text", "good"))
        target, raw = bag(sample.where("good")), bag(sample)
        self.table = self.spark.sparkContext.broadcast(ratios(target, raw))  # SLOTS numbers
        scored = sample.mapInArrow(tidy(_left_out(self.spark.sparkContext.broadcast((target, raw)))), "good boolean, score double").collect()  # at most ``most``
        self.cut = best_cut(*(np.array([r["score"] for r in scored if r["good"] is kind]) for kind in (True, False))) - 1e-9
        scratch.drop("labelled")

    def keys(self, documents: DataFrame) -> DataFrame:
        """``doc_id, score, key``: log importance, and that with the row's noise."""
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
        return rows.mapInArrow(tidy(_keys(self.table, self.seed)), "doc_id long, score double, key double")

    def drawn(self, documents: DataFrame, k: int | None = None) -> tuple[DataFrame, float]:
        """Keys of all rows, and the least key of the ``k`` drawn (all that pass the cut, if none is given)."""
        keys = Scratch(self.spark).keep("keys", self.keys(documents))
        if k is None:
            k = keys.where(F.col("score") >= self.cut).count()
        if k <= 0:
            return keys, float("inf")
        ranked = prefix_sums(keys.withColumn("one", F.lit(1).cast("long")), [F.negative("key")], "one")
        last = ranked.where(F.col("row_before") < k).agg(F.min("key")).first()[0]
        return keys, float("inf") if last is None else last


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, most: int = LABELLED, seed: int = 1) -> DataFrame:
    """``doc_id, score, key, kept``: one row per document row.

    ``score`` is the log importance, ``key`` adds Gumbel noise of the row's id and
    text, and ``kept`` marks the ``k`` highest keys (by default as many as pass
    the cut; rows that tie with the last are kept too). ``labels`` has ``doc_id,
    quality, toxic``; a document is good with quality 1 and not toxic (a null
    toxic is not), and of repeated labels the worst counts. Labels without a
    document, and null ids, teach nothing. At most ``most`` labelled documents
    are learned from. A null or empty text
    scores 0. Without good labels nothing is told apart and all is kept. Other
    columns are ignored.
    """
    keys, last = Classifier(documents, labels, most, seed).drawn(documents, k)
    return keys.withColumn("kept", F.col("key") >= F.lit(last))


def keep_good(documents: DataFrame, labels: DataFrame, k: int | None = None, most: int = LABELLED, seed: int = 1) -> DataFrame:
    """The kept rows of ``documents``, columns as they were. Keys are computed again, nothing is joined."""
    classifier = Classifier(documents, labels, most, seed)
    _, last = classifier.drawn(documents, k)
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    table = classifier.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            score = importance(*vec.utf8(row.field("text")), table.value)
            noise = gumbel(row.field("doc_id").cast(pa.int64()).fill_null(0).to_numpy(), batch.column(1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(SHARPNESS * score + noise >= last))], ["row"])

    return rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")

"""Document fingerprints from improbable byte windows.

Every 64-byte window has an entropy score. Scores that few windows of the corpus
have rank first; a window that has the lowest rank of its neighbourhood often
enough is a feature. Features go into Bloom filters of 2,048 bits, each holding
up to 160 and followed by the next. Two fingerprints are compared by the bits
their filters share, beyond those that chance explains.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import vec
from wardlake.llm.scratch import partitions

WINDOW = 64
NEIGHBOURS = 64  # windows among which the lowest rank is looked for
POPULAR = 16  # how often a window must be the lowest
BITS, HASHES, FULL = 2048, 5, 160
SCORES = 1001
PIECE = 1 << 18  # bytes looked at together

#: Share of a window's information by a count, in whole numbers, so that sums are exact.
_TERMS = np.rint(np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)]) * (1 << 20)).astype(np.int64)
_MOST = int(_TERMS[WINDOW])


def scores(b: np.ndarray) -> np.ndarray:
    """Entropy of each window, 0 (one byte value) to 1000 (all different)."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    later = np.zeros(n, np.uint8)  # equal bytes among the next 63
    earlier = np.zeros(n, np.uint8)  # and among the 63 before
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        later[: n - d] += same
        earlier[d:] += same
    # Moving a window on by one drops its first byte and adds one at its end.
    out, new = later[: n - WINDOW].astype(np.intp) + 1, earlier[WINDOW:].astype(np.intp)
    change = _TERMS[new + 1] - _TERMS[new] - _TERMS[out] + _TERMS[out - 1]
    first = _TERMS[np.bincount(b[:WINDOW], minlength=256)].sum()
    held = np.concatenate([[first], change]).cumsum()
    return ((_MOST - held) * (SCORES - 1) // _MOST).astype(np.int16)


def _valid(o: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts from which ``width`` bytes lie inside one row."""
    return np.repeat(o[1:], np.diff(o))[:n] - np.arange(n) >= width


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SCORES, np.int64)
    for batch in batches:
        for _, _, b, o in vec.pieces(*vec.utf8(batch.column(0)), PIECE):
            found = scores(b)
            counts += np.bincount(found[_valid(o, len(found), WINDOW)], minlength=SCORES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SCORES), pa.int32()), pa.array(counts)], ["score", "n"])


def rarity(documents: DataFrame) -> np.ndarray:
    """Rank of each entropy score by how many windows of all documents have it, the rarest first.

    Scores no window has rank before all others, and ties go to the lower score.
    The score 0, of one byte repeated, says nothing and ranks last.
    """
    sums = documents.select("text").mapInArrow(_histogram, "score int, n long").groupBy("score").agg(F.sum("n").alias("n"))
    counts = np.zeros(SCORES, np.int64)
    for row in sums.collect():  # SCORES rows
        counts[row["score"]] = row["n"]
    counts[0] = np.iinfo(np.int64).max
    rank = np.empty(SCORES, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(SCORES)
    return rank


def features(b: np.ndarray, o: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the selected windows, in order.

    A row without a popular window has its lowest one; a row shorter than a
    window is one feature, an empty row none.
    """
    found, sizes = scores(b), np.diff(o)
    n, bits = len(found), 40
    start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        inside = _valid(o, n, WINDOW)
        key = np.where(inside, rank[found] << bits | np.arange(n), np.iinfo(np.int64).max)
        popular = np.zeros(n, np.int64)
        least = vec.window_first(key, NEIGHBOURS)
        whole = _valid(o, len(least), WINDOW + NEIGHBOURS - 1)
        popular += np.bincount(least[whole] & ((1 << bits) - 1), minlength=n)
        chosen = (popular >= POPULAR) & inside & (found > 0)
        some = np.concatenate([[0], np.cumsum(chosen)])
        none = some[np.minimum(o[1:], n)] == some[np.minimum(o[:-1], n)]
        for r in np.flatnonzero(none & (sizes >= WINDOW)).tolist():
            lo, hi = o[r], o[r + 1] - WINDOW + 1
            chosen[lo + int(np.argmin(key[lo:hi]))] = True
        start = np.flatnonzero(chosen)
        end = start + WINDOW
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    start, end = np.concatenate([start, o[short]]), np.concatenate([end, o[short + 1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return vec.span(vec.prefix(b), start, end), np.searchsorted(o, start, "right") - 1


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained filters (rows of bits) of a document's distinct features."""
    if not len(hashes):
        return np.zeros((0, BITS), np.uint8)
    _, first = np.unique(hashes, return_index=True)
    distinct = hashes[np.sort(first)]
    chain = np.zeros((-(-len(distinct) // FULL), BITS), np.uint8)
    which = np.arange(len(distinct)) // FULL
    for i in range(HASHES):
        chain[which, ((distinct >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.intp)] = 1
    return chain


def digests(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for low, high, b, o in vec.pieces(buf, off, PIECE):
        hashes, row = features(b, o, rank)
        ends = np.searchsorted(row, np.arange(high - low + 1))
        out += [digest(hashes[s:e]) for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other.

    The bits two filters share count from what chance gives (0) to all the
    smaller one has (1). Two chains without a filter are alike, one is not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    x, y = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
    both = a.astype(np.float32) @ b.astype(np.float32).T
    most = np.minimum(x[:, None], y[None, :])
    chance = x[:, None] * y[None, :] / BITS
    share = (both - chance) / np.maximum(most - chance, 1e-9)
    return float(np.clip(share, 0, 1).max(axis=1).mean())


def spell(chain: np.ndarray) -> str:
    """The chain as text: filters in order, 256 bytes each, in base 64."""
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


# ----------------------------------------------------------------- neighbours


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text`` in ordered ranges, each followed by ``guard`` rows: the row after its last.

    The order is that of ``doc_id``, null first, then of a hash of the text. The
    table's last row is followed by its first. The text is exchanged once; of the
    ids, only those at the ends of ranges reach the driver. Ranges are cut by id and
    hash, so rows without an id, or under one id, spread over as many ranges as they fill.
    """
    text = F.coalesce("text", F.lit(""))
    lowest = documents.agg(F.min("doc_id")).first()[0] or 0
    # Grows with id and hash, if not always strictly: rows of one number share a range.
    share = F.xxhash64(text).cast("double") / 2.0**64 + 0.5
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(lowest) - 1)) + share
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), number.alias("number"))
    cuts = documents.select(number.alias("number")).approxQuantile("number", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    splits = splits if len(splits) > 2 else [float("-inf"), 0.0, float("inf")]
    rows = Bucketizer(splits=splits, inputCol="number", outputCol="range").transform(rows).drop("number")
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    heads = sorted((r["range"], *r["first"]) for r in firsts.select("range", "first").collect())  # a row per range
    schema = "id long, hash long, before double"
    ends = [(doc_id, tie, heads[i - 1][0]) for i, (_, doc_id, tie) in enumerate(heads)]
    ends = documents.sparkSession.createDataFrame(ends, schema)
    guards = rows.join(F.broadcast(ends), F.expr("doc_id <=> id AND tie = hash")).select("doc_id", "text", "tie", F.col("before").alias("range"), F.lit(True).alias("guard"))
    dealt = rows.select("doc_id", "text", "tie", "range", F.lit(False).alias("guard")).union(guards)
    return dealt.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range", "guard", F.asc_nulls_first("doc_id"), "tie")


SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(rank):
    def columns(texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8") for t in texts]
        return digests(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), rank.value)

    def emit(ids, texts, own, following, following_digests):
        edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
        changed = columns(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([spell(x) for x in own], pa.string()),
                pa.array([spell(x) for x in changed], pa.string()),
                pa.array([likeness(x, y) for x, y in zip(own, changed, strict=True)], pa.float64()),
                pa.array([likeness(x, y) for x, y in zip(own, following_digests, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next is still to come: id, text, digest, range
        for batch in batches:
            buf, off = vec.utf8(batch.column(1))
            for low, high, b, o in vec.pieces(buf, off, 1 << 20):
                raw = b.tobytes()
                texts = [raw[x:y].decode("utf-8") for x, y in zip(o.tolist(), o[1:].tolist(), strict=False)]
                own = columns(texts)
                ids, guard, part = (batch.column(c).slice(low, high - low).to_pylist() for c in (0, 4, 3))
                out = ([], [], [], [], [])
                for i, text in enumerate(texts):
                    if held is not None and held[3] == part[i]:
                        for x, y in zip(out, (held[0], held[1], held[2], text, own[i]), strict=True):
                            x.append(y)
                        held = None
                    if not guard[i]:
                        held = (ids[i], text, own[i], part[i])
                if out[0]:
                    yield emit(*out)

    return run


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    ``edited`` is the text with its last quarter of characters replaced by the
    first of the next document's (ascending ``doc_id``; rows with one id by a
    hash of their text; null ids first; after the last comes the first, so a
    single row is its own next). ``near_...`` is the likeness, 0 to 1, of the
    text's fingerprint to the edited text's and to the next text's. Equal texts
    have equal fingerprints. A null text is empty, and an empty text has the
    empty fingerprint, like only to itself. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    rank = spark.sparkContext.broadcast(rarity(documents))  # SCORES numbers
    return with_next(documents, partitions(spark)).mapInArrow(_compare(rank), SCHEMA)

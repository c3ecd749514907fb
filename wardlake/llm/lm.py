"""Language-model scoring: a bigram model with deleted interpolation.

``p(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 1/(V+1)``, the weights chosen by how
often the context ``v`` was seen (one set for each power of two), and learned by
expectation-maximisation on held-out counts: each training token is scored with
its own occurrence deleted from every count.

Counting and scoring exchange no tokens. A chunk of documents asks for the
counts of its distinct words and bigrams, packed and sorted; each range of
hashes adds up what all chunks hold and answers each chunk in its own order.
What travels grows with the distinct words and bigrams of the chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import vec
from wardlake.llm.packed import pack, ranges, unpack
from wardlake.llm.scratch import Scratch, partitions, small_batches, tidy

CHUNK = 8 << 20  # bytes of text that ask together
END, START = np.uint64(0x5EED_0E2D_0000_0001), np.uint64(0x5EED_57A2_0000_0002)
BUCKETS = 48  # of context frequency, one for each power of two
STEP = 4  # cells of the held-out table to a power of two
ROUNDS = 60


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their contexts and rows: the words of each row and one end."""
    hashes, row = vec.word_hashes(buf, off)
    n = len(off) - 1
    count = np.bincount(row, minlength=n) if n else np.zeros(0, np.int64)
    ends = np.cumsum(count + 1) - 1
    out = np.empty(len(hashes) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, hashes
    context = np.empty_like(out)
    context[1:] = out[:-1]
    context[np.concatenate([[0], ends[:-1] + 1]) if n else []] = START
    return out, context, np.repeat(np.arange(n), count + 1)


def bigrams(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return vec.mix(context * np.uint64(0x9FB21C651E98DF25) + vec.mix(token))


def tally(hashes: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and how often each occurs in training rows."""
    own, which = np.unique(hashes, return_inverse=True)
    return own, np.bincount(which, weights=training, minlength=len(own)).astype(np.int64)


class Chunk:
    """Some documents as one request: text, ids, and the distinct words and bigrams they need counts of."""

    def __init__(self, text: list[bytes], training: np.ndarray):
        off = np.cumsum([0, *map(len, text)])
        parts = [(lo, *tokens(b, o)) for lo, _, b, o in vec.pieces(np.frombuffer(b"".join(text), np.uint8), off)]
        self.token = np.concatenate([x[1] for x in parts])
        self.context = np.concatenate([x[2] for x in parts])
        self.row = np.concatenate([x[3] + x[0] for x in parts])
        self.training = training[self.row]
        self.pair = bigrams(self.token, self.context)


HEADS = "chunk string, ids binary, texts binary"
ASKS = "chunk string, part int, kind int, asks binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into chunks, which have a name from here on."""

    def flush(ids, null, training, texts):
        head = pack(np.array(ids, np.int64), np.array(null), np.array(training))
        body = pack(np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
        row = {"chunk": uuid.uuid4().hex, "ids": head, "texts": body}
        for held in (ids, null, training, texts):
            held.clear()
        return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.string()), ("ids", pa.binary()), ("texts", pa.binary())]))

    ids, null, training, texts, size = [], [], [], [], 0
    for batch in batches:
        buf, off = vec.utf8(batch.column(2))
        for i, (number, train) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            texts.append(buf[off[i] : off[i + 1]].tobytes())
            ids.append(number or 0), null.append(number is None), training.append(train)
            size += len(texts[-1])
            if size >= CHUNK:
                yield flush(ids, null, training, texts)
                size = 0
    if texts:
        yield flush(ids, null, training, texts)


def _load(ids: bytes, texts: bytes):
    number, null, training = unpack(ids)
    sizes, text = unpack(texts)
    ends, raw = np.cumsum(sizes), text.tobytes()
    chunk = Chunk([raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], training)
    return chunk, number, null, training


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk, rows = _load(ids, texts)[0], []
                for kind, hashes in enumerate((chunk.token, chunk.pair)):
                    own, count = tally(hashes, chunk.training)
                    for part, s, e in ranges(own, parts):
                        blob = pack(np.diff(own[s:e], prepend=np.uint64(0)), count[s:e].astype(np.uint32))
                        rows.append((name, part, kind, blob))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "kind", "asks"])

    return run


def _answer(key: tuple, asks: pa.Table) -> pa.Table:
    """The counts of one range over all chunks, for each chunk in the order it asked.

    A word is as often a context as it occurs, and a start as often as an end.
    """
    own, counts = [], []
    for blob in asks["asks"]:
        deltas, n = unpack(blob.as_py())
        own.append(np.cumsum(deltas, dtype=np.uint64)), counts.append(n.astype(np.int64))
    every, which = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(x) for x in own])
    found = [pack(total[which[e - len(x) : e]].astype(np.uint64)) for x, e in zip(own, ends.tolist(), strict=True)]
    n = len(found)
    return pa.table(
        {
            "chunk": asks["chunk"],
            "part": asks["part"],
            "kind": asks["kind"],
            "counts": pa.array(found, pa.binary()),
            # Of the range, on its first row: distinct trained words and all trained tokens.
            "distinct": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
            "total": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()),
        }
    )


ANSWERS = "chunk string, part int, kind int, counts binary, distinct long, total long"


def _read(batch: pa.RecordBatch, i: int):
    """A chunk with the counts of each of its tokens: bigram, context and word."""
    chunk, ids, null, training = _load(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
    answers = sorted((x["kind"], x["part"], x["counts"]) for x in batch.column(2)[i].as_py())
    by_kind = [np.concatenate([unpack(b)[0] for k, _, b in answers if k == kind]).astype(np.int64) for kind in (0, 1)]
    words, word = np.unique(chunk.token, return_inverse=True)
    _, pair = np.unique(chunk.pair, return_inverse=True)
    c_word, c_pair = by_kind[0][word], by_kind[1][pair]
    at = np.searchsorted(words, chunk.context)
    at[at == len(words)] = 0
    c_context = by_kind[0][at]
    starts = chunk.context == START
    # As many starts as ends; the end's count is asked for by every chunk.
    c_context[starts] = by_kind[0][np.searchsorted(words, END)]
    return chunk, ids, null, training, c_pair, c_context, c_word


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its power of two."""
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _parts(pair, context, word, total, distinct):
    return pair / np.maximum(context, 1), word / max(total, 1), 1.0 / (distinct + 1)


def _held_out(total: int, distinct: int):
    """Cells of (bucket, bigram ratio, word ratio): how many training tokens, each deleted from its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, _, _, _, pair, context, word = _read(batch, i)
                own = chunk.training
                p2, p1, p0 = _parts(pair[own] - 1, context[own] - 1, word[own] - 1, total - 1, distinct)
                least = 2.0**-60
                cell = np.stack(
                    [bucket(context[own] - 1), np.rint(STEP * np.log2(np.maximum(p2 / p0, least))), np.rint(STEP * np.log2(np.maximum(p1 / p0, least)))],
                    axis=1,
                ).astype(np.int64)
                names, n = np.unique(cell, axis=0, return_counts=True) if len(cell) else (cell, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(names[:, j]) for j in range(3)), pa.array(n)], ["bucket", "r2", "r1", "n"])
                del chunk, own, pair, context, word, p2, p1, p0, cell  # before the next one is read

    return run


def maximise(cells: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket, by expectation-maximisation on the held-out cells."""
    # Where nothing was held out, words alone; where nothing was learned, no words either.
    weights = np.tile((0.0, 0.99, 0.01) if cells else (0.0, 0.0, 1.0), (BUCKETS, 1))
    table = np.array(cells, np.float64).reshape(-1, 4)
    for b in range(BUCKETS):
        own = table[table[:, 0] == b]
        if len(own):
            weights[b] = 1 / 3
            ratios = np.stack([2 ** (own[:, 1] / STEP), 2 ** (own[:, 2] / STEP), np.ones(len(own))], axis=1)
            ratios[:, :2][ratios[:, :2] <= 2.0**-59] = 0
            for _ in range(ROUNDS):
                share = ratios * weights[b]
                share /= share.sum(axis=1, keepdims=True)
                weights[b] = (share * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
            # An unseen word must keep some probability.
            weights[b] = np.maximum(weights[b], 1e-6) / np.maximum(weights[b], 1e-6).sum()
    return weights


SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, ids, null, training, pair, context, word = _read(batch, i)
                p2, p1, p0 = _parts(pair, context, word, total, distinct)
                w = weights[bucket(context)]
                p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0
                base = np.log10((word + 1) / (total + distinct + 1))
                n = len(ids)
                add = lambda x: np.bincount(chunk.row, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=null),
                        pa.array(training),
                        pa.array(np.bincount(chunk.row, minlength=n)),
                        pa.array(add(word > 0).astype(np.int64)),
                        pa.array(np.full(n, total)),
                        pa.array(add(base)),
                        pa.array(add(np.log10(p))),
                    ],
                    ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del chunk, pair, context, word, p2, p1, p0, w, p, base, add  # before the next one is read

    return run


def score(documents: DataFrame, training) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score``: one row per document row.

    ``training`` is a condition on ``documents``; the rows that meet it are
    learned from (a null condition is not met). Words are runs without ASCII
    white space, A-Z in lower case; each text ends with one end token, so a null
    or empty text is that token alone. ``base_score`` is the add-one unigram
    score, ``score`` the model's, both log10 of the text's probability. Without
    training rows every token has the uniform probability. Rows that repeat an
    id are scored one by one; other columns are ignored.
    """
    spark = documents.sparkSession
    scratch, parts = Scratch(spark), partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("t"), "text")
    with small_batches(spark):
        heads = scratch.keep("chunks", rows.mapInArrow(tidy(_chunks), HEADS))
    with small_batches(spark, 1):  # a row is a chunk
        return _scored(heads, scratch, parts)


def _scored(heads: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    asks = heads.mapInArrow(tidy(_ask(parts)), ASKS)
    answers = scratch.keep("answers", asks.groupBy("part", "kind").applyInArrow(_answer, ANSWERS))
    sums = answers.where("kind = 0").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = (int(x or 0) for x in sums)
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("answers"))
    chunks = scratch.keep("counted", heads.join(by_chunk, "chunk").select("ids", "texts", "answers"))
    scratch.drop("chunks", "answers")
    cells = chunks.mapInArrow(tidy(_held_out(total, distinct)), "bucket long, r2 long, r1 long, n long")
    held = cells.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))  # a bounded grid
    weights = maximise([tuple(r) for r in held.collect()])
    scores = scratch.keep("scores", chunks.mapInArrow(tidy(_score(weights, total, distinct)), SCORES))
    scratch.drop("counted")
    return scores

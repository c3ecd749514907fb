"""Byte-pair encoding and decoding of whole tables with a shared-suffix lexicon.

The most frequent words of all documents are compiled, with their ids, into a
minimal acyclic transducer. It is written once below the shared folder, sent to
every executor by Spark and mapped into memory. Words it lacks are merged
exactly; each process remembers those it met lately.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bpe, pretok, vec
from wardlake.llm.lexicon import Lexicon, compile_lexicon
from wardlake.llm.scratch import Scratch, tidy
from wardlake.session import scratch_path

WORDS = 1 << 16  # words in the lexicon
LONGEST = 64  # bytes of a word that may enter it
REMEMBERED = 1 << 17  # unseen words a process keeps


def units(buf: np.ndarray, off: np.ndarray, special: dict[str, int]):
    """Start, end and row of each unit in bytes; special strings are one unit, with its id beside (else -1)."""
    points, byte = pretok.code_points(buf)
    if not len(points):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    from_, to, ids = bpe.special_spans(buf, off, special)
    edge = np.zeros(len(points) + 1, bool)
    edge[np.searchsorted(byte, np.concatenate([off, from_, to]))] = True
    first = pretok.spaced(points, edge[:-1])
    start = byte[first]
    end = np.append(start[1:], len(buf))
    kind = np.full(len(start), -1, np.int64)
    if len(from_):
        inside = np.searchsorted(from_, start, "right") - 1
        held = (inside >= 0) & (start < to[inside])
        kind[held] = ids[inside[held]]
        head = held & (start == from_[inside])
        end[head] = to[inside[head]]
        keep = ~held | head
        start, end, kind = start[keep], end[keep], kind[keep]
    return start, end, np.searchsorted(off, start, "right") - 1, kind


# ------------------------------------------------------------------- lexicon


def _counter(path: str):
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = bpe.vocabulary(path).special
        held: dict[int, list] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held.values()], pa.binary()), pa.array([x[1] for x in held.values()], pa.int64())], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            buf, off = vec.utf8(batch.column(0))
            for _, _, b, o in vec.pieces(buf, off, 1 << 20):
                start, end, _, kind = units(b, o, special)
                fits = (kind < 0) & (end - start <= LONGEST)
                start, end = start[fits], end[fits]
                names, first, n = np.unique(bpe.hashes(b, start, end), return_index=True, return_counts=True)
                raw = b.tobytes()
                for name, s, e, c in zip(names.tolist(), start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                    if name in held:
                        held[name][1] += c
                    else:
                        held[name] = [raw[s:e], c]
                if len(held) > REMEMBERED:
                    yield flush()
        if held:
            yield flush()

    return run


def frequent_words(documents: DataFrame, path: str, most: int = WORDS) -> list[bytes]:
    """The most frequent units of all texts, ``most`` at most, which is also what the driver gets.

    Counts are cut where a step of a sixteenth of a power of two would take in
    more, so no list of candidates per task is needed.
    """
    scratch = Scratch(documents.sparkSession)
    counted = documents.select("text").mapInArrow(tidy(_counter(path)), "word binary, n long")
    step = F.floor(F.log2(F.sum("n")) * 16).alias("step")
    words = scratch.keep("words", counted.groupBy("word").agg(step))
    taken, last = 0, None
    for row in words.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # a row per step
        if taken + row["n"] > most:
            break
        taken, last = taken + row["n"], row["step"]
    found = [] if last is None else [bytes(r["word"]) for r in words.where(F.col("step") >= last).select("word").collect()]
    scratch.drop("words")
    return found


def publish_lexicon(spark: SparkSession, words: list[bytes], path: str) -> str:
    """Compiles ``words`` and sends the file to all executors; the name to open it by."""
    own = bpe.vocabulary(path)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ids, count = own.encode_words(flat, np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends, ends)
    cut = np.cumsum(count)
    body = compile_lexicon(words, [x.tolist() for x in np.split(ids, cut[:-1])] if words else [])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{scratch_path(spark, 'llm-lexicon')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(place)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(body))
    finally:
        stream.close()
    spark.sparkContext.addFile(place)
    return name


# ------------------------------------------------------------------ encoding


class Encoder:
    """Encodes columns of text; one per process and lexicon."""

    def __init__(self, path: str, lexicon: str):
        self.vocabulary = bpe.vocabulary(path)
        self.lexicon = Lexicon(lexicon)
        self._forget()

    def _forget(self):
        self.seen: dict[int, int] = {}  # hash of an unseen word to its place below
        self.starts, self.counts, self.flat, self.size = [], [], [], 0

    def _unseen(self, buf, names, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and count in a flat array of ids, of each distinct word the lexicon lacks."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        fresh = np.array([n not in self.seen for n in names.tolist()], bool)
        ids, count = self.vocabulary.encode_words(buf, start[fresh], end[fresh])
        place = len(self.starts)
        self.seen.update(zip(names[fresh].tolist(), range(place, place + len(count)), strict=True))
        self.starts += (np.cumsum(count) - count + self.size).tolist()
        self.counts += count.tolist()
        self.flat.append(ids)
        self.size += len(ids)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        at = [self.seen[n] for n in names.tolist()]
        return self.flat[0], np.array([self.starts[i] for i in at], np.int64), np.array([self.counts[i] for i in at], np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each row."""
        start, end, row, kind = units(buf, off, self.vocabulary.special)
        names, first, which = np.unique(bpe.hashes(buf, start, end), return_index=True, return_inverse=True)
        s, e, k = start[first], end[first], kind[first]
        place = self.lexicon.find(buf, s, e)
        place[k >= 0] = -1
        known, own = place >= 0, (place < 0) & (k < 0)
        flat, at, count = self._unseen(buf, names[own], s[own], e[own])
        base = len(self.lexicon.ids)
        begin, size = np.zeros(len(names), np.int64), np.ones(len(names), np.int64)
        begin[known], size[known] = self.lexicon.at[place[known]], self.lexicon.at[place[known] + 1] - self.lexicon.at[place[known]]
        begin[own], size[own] = at + base, count
        begin[k >= 0] = base + len(flat) + np.arange((k >= 0).sum())
        every = np.concatenate([self.lexicon.ids, flat, k[k >= 0].astype(np.int32)])
        ids = bpe.gather(every, begin[which], size[which])
        per_row = np.bincount(row, weights=size[which], minlength=len(off) - 1).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(per_row)])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    if (path, name) not in _encoders:
        _encoders.clear()
        _encoders[path, name] = Encoder(path, os.path.join(SparkFiles.getRootDirectory(), name))
    return _encoders[path, name]


IDS = pa.list_(pa.int32())


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, name)
        for batch in batches:
            buf, off = vec.utf8(batch.column(0).field("text"))
            for low, high, b, o in vec.pieces(buf, off, 1 << 20):
                ids, ends = own.encode(b, o)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["row", "ids"])

    return run


def encode(documents: DataFrame, path: str, most: int = WORDS) -> DataFrame:
    """``row, ids``: each row of ``documents`` as a struct, and the token ids of its whole text.

    Ids are those of the file's own library, special strings inside a text being
    their special token, nothing added. A null or empty text has no ids. Repeated
    rows and other columns, whatever their names, come back as they are. An empty
    table gives no rows.
    """
    name = publish_lexicon(documents.sparkSession, frequent_words(documents, path, most), path)
    rows = documents.select(F.struct("*").alias("row"))
    return rows.mapInArrow(tidy(_encode(path, name)), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = bpe.Decoder(path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            ends, low = np.cumsum(counts), 0
            while low < len(batch):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
                own = batch.slice(low, high - low)
                ids = own.column(1).flatten().fill_null(-1).to_numpy()
                texts = decoder.texts(ids, np.concatenate([[0], ends[low:high] - before]))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], ["row", "ids", "decoded"])
                low = high

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``row, ids, decoded``: ``encoded`` with the text of its ids, special tokens included.

    Null ids are an empty text; ids outside the vocabulary are left out.
    """
    kind = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(_decode(path), f"row {kind}, ids array<int>, decoded string")

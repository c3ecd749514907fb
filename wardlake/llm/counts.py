"""Exact token counts at every prefix of a text.

For a word, two tables are filled from left to right. ``N[j]`` is the number of
tokens of its first ``j`` bytes and ``L[j]`` the last of them: the only token
that ends there and stays apart from ``L`` where it begins. ``E[j]`` is the
number when the word ends at ``j``, found the same way with the tokens that end
words. A text's table is the running sum over its words, so the count of any
prefix, or the longest prefix within a budget, is a lookup.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.normalizers import Lowercase

from wardlake.llm import bpe, pretok, vec
from wardlake.llm.packed import pack, unpack

REMEMBERED = 1 << 18  # distinct words a process keeps
PAIRS = 1 << 20  # slots for token pairs


def normal(text: str) -> tuple[str, str]:
    """The text's composed form, whose characters the table counts, and what is split: that in lower case."""
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    if not text.isascii() and _unassigned()[np.frombuffer(composed.encode("utf-32-le"), np.uint32)].any():
        return composed, Lowercase().normalize_str(composed)  # newer letters than Python knows
    return composed, composed.replace("Σ", "σ").lower()  # never the final sigma


@functools.cache
def _unassigned() -> np.ndarray:
    """Code points without a category here; planes beyond the first two have no case."""
    table = np.zeros(0x110000, bool)
    table[:0x20000] = [unicodedata.category(chr(c)) == "Cn" for c in range(0x20000)]
    return table


class Prefixes:
    """Prefix counts of words; one per process and file."""

    def __init__(self, path: str):
        self.vocabulary = v = bpe.vocabulary(path)
        self.sizes = np.array([len(t) for t in v.spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(v.spelled), np.uint8)
        # What is known of token pairs; a slot forgets the pair before.
        self.pair_key, self.pair_apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        spelled = [(i, t) for i, t in enumerate(v.spelled) if t and i not in set(v.special.values())]
        self.tables = []
        for ends in (False, True):
            own = [(i, t) for i, t in spelled if bool(v.ends[i]) == ends or not v.suffix]
            flat = np.frombuffer(b"".join(t for _, t in own), np.uint8)
            stop = np.cumsum([len(t) for _, t in own])
            start = stop - [len(t) for _, t in own]
            ids = np.array([i for i, _ in own])
            alone = self._alone(start, stop, ids)
            names = bpe.hashes(flat, start, stop)[alone]
            order = np.argsort(names)
            sizes = np.unique((stop - start)[alone])
            self.tables.append((names[order], ids[alone][order], sizes))
        self.seen: dict[int, tuple[int, int]] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.size = 0

    def _symbols(self, tokens: np.ndarray, width: int) -> np.ndarray:
        v, size = self.vocabulary, self.sizes[tokens]
        column = np.arange(width)
        body = self.bytes[np.minimum(self.starts[tokens][:, None] + column, len(self.bytes) - 1)]
        symbols = v.first[body]
        tail = np.flatnonzero(v.ends[tokens])
        symbols[tail, size[tail] - 1] = v.last[body[tail, size[tail] - 1]]
        return symbols

    def _alone(self, start, stop, ids) -> np.ndarray:
        """Tokens that their own bytes merge to; no text ever has the others."""
        merged, n = self.vocabulary.merge(self._symbols(ids, int((stop - start).max())), self.sizes[ids])
        return (n == 1) & (merged[:, 0] == ids)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two neighbouring tokens stay as they are when their bytes are merged together."""
        key = left << 32 | right
        slot = (vec.mix(key.view(np.uint64)) & np.uint64(PAIRS - 1)).view(np.int64)
        out = self.pair_apart[slot]
        unknown = np.flatnonzero(self.pair_key[slot] != key)
        if len(unknown):
            fresh, which = np.unique(key[unknown], return_inverse=True)
            a, b = fresh >> 32, fresh & 0xFFFFFFFF
            size, other = self.sizes[a], self.sizes[b]
            same = np.zeros(len(fresh), bool)
            for low, high in ((0, 8), (8, 16), (16, 1 << 30)):
                own = np.flatnonzero((size + other > low) & (size + other <= high))
                if len(own):
                    width = int((size + other)[own].max())
                    x, y, n = self._symbols(a[own], width), self._symbols(b[own], width), size[own][:, None]
                    column = np.arange(width)
                    shifted = np.take_along_axis(y, np.clip(column - n, 0, width - 1), axis=1)
                    merged, left_over = self.vocabulary.merge(np.where(column < n, x, shifted), (size + other)[own])
                    same[own] = (left_over == 2) & (merged[:, 0] == a[own]) & (merged[:, 1] == b[own])
            out[unknown] = same[which]
            self.pair_key[slot[unknown]], self.pair_apart[slot[unknown]] = key[unknown], same[which]
        return out

    def _last(self, sums, j: int, table, last: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of the first ``j`` bytes of each row, and where it begins."""
        names, ids, sizes = table
        token, begin = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        for size in sizes[sizes <= j][::-1].tolist():
            if not len(todo):
                break
            i = j - size
            own = rows[todo]
            low = vec._power(1, i + 1)[i : i + 1]
            name = vec.mix((sums[own, j] - sums[own, i]) * low + np.array([size], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            hit = names[at] == name
            if i and hit.any():
                hit[hit] = self._apart(last[own[hit], i], ids[at[hit]])
            token[todo[hit]], begin[todo[hit]] = ids[at[hit]], i
            todo = todo[~hit]
        return token, begin

    def words(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``E`` of each word (a row) at each prefix (a column), and which columns end a character."""
        n, width = len(start), int(size.max())
        column = np.arange(width)
        body = buf[np.minimum(start[:, None] + column, len(buf) - 1)]
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * vec._power(0, width), axis=1, out=sums[:, 1:])
        whole = np.zeros((n, width + 1), np.int32)
        last = np.zeros((n, width + 1), np.int64)
        ended = np.zeros((n, width), np.int32)
        boundary = column < size[:, None]
        # Counts are asked for at characters only.
        boundary[:, :-1] &= ((body[:, 1:] & 0xC0) != 0x80) | (column[1:] == size[:, None])
        for j in range(1, width + 1):
            own = np.flatnonzero(boundary[:, j - 1])
            _, begin = self._last(sums, j, self.tables[1], last, own)
            ended[own, j - 1] = whole[own, begin] + 1
            more = np.flatnonzero(size > j)
            last[more, j], begin = self._last(sums, j, self.tables[0], last, more)
            whole[more, j] = whole[more, begin] + 1
        return ended, boundary

    def steps(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, ending: np.ndarray):
        """For each word: where in a flat array the changes of its count from character to character are, and how many."""
        names = bpe.hashes(buf, start, end)
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.flat, self.size = [np.zeros(0, np.int32)], 0
        fresh = first[[n not in self.seen for n in distinct.tolist()]] if len(distinct) else first
        size = end[fresh] - start[fresh]
        few = [(0, 6), (6, 10), (10, 16), (16, 32)]
        for low, high in [*few, *((w - 1, w) for w in np.unique(size[size > 32]).tolist())]:
            held = (size > low) & (size <= high)
            own = fresh[held]
            if not len(own):
                continue
            ended, boundary = self.words(buf, start[own], size[held])
            # A three-letter ending cut after its letter is two units, not one.
            cut = ending[own] & (size[held] == 3)
            ended[cut, 1] = 2
            count = boundary.sum(axis=1)
            flat = ended[boundary]
            at = np.cumsum(count) - count
            step = np.diff(flat, prepend=0)
            step[at] = flat[at]
            self.flat.append(step.astype(np.int32))
            places = zip((at + self.size).tolist(), count.tolist(), strict=True)
            self.seen.update(zip(names[own].tolist(), places, strict=True))
            self.size += len(step)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        places = np.array([self.seen[n] for n in distinct.tolist()], np.int64).reshape(-1, 2)
        return self.flat[0], places[which, 0], places[which, 1]

    def table(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the change of the token count at each character of its composed form."""
        special = self.vocabulary.special
        parts: list[str] = []
        plan: list[list] = []  # of each text: composed parts, or the length of a special string
        for text in texts:
            cut, own = [text], []
            for s in sorted(special, key=len, reverse=True):
                if s in text:
                    cut = [y for x in cut for y in _around(x, s)] if len(cut) > 1 or s in cut[0] else cut
            for piece in cut:
                if piece in special:
                    own.append((None, len(piece)))
                elif piece:
                    composed, lowered = normal(piece)
                    own.append((len(parts), composed))
                    parts.append(lowered)
            plan.append(own)
        raw = [p.encode("utf-8") for p in parts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        points, byte = pretok.code_points(buf)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        step = np.zeros(len(points), np.int32)
        if len(points):
            edge = np.zeros(len(points) + 1, bool)
            edge[np.concatenate([[0], ends])] = True
            first, stop, ending = pretok.unspaced(points, edge[:-1])
            byte = np.append(byte, len(buf))
            flat, at, count = self.steps(buf, byte[first], byte[stop], ending)
            step[bpe.gather(np.arange(len(points)), first, count)] = bpe.gather(flat, at, count)
        out = []
        for own in plan:
            pieces = [np.zeros(0, np.int32)]
            for i, held in own:
                if i is None:
                    # Its characters before the last are counted as the special string is: not yet.
                    pieces.append(np.array([0] * (held - 1) + [1], np.int32))
                    continue
                mine = step[ends[i] - sizes[i] : ends[i]]
                if len(mine) != len(held):  # a character with a longer lower case counts at its end
                    grown = np.cumsum([len(normal(c)[1]) for c in held])
                    mine = np.diff(np.cumsum(mine)[grown - 1], prepend=0)
                pieces.append(mine)
            out.append(np.concatenate(pieces).astype(np.int32))
        return out


def _around(text: str, special: str) -> list[str]:
    found = []
    for i, piece in enumerate(text.split(special)):
        found += [special, piece] if i else [piece]
    return found


@functools.cache
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def _narrow(step: np.ndarray) -> bytes:
    small = len(step) == 0 or (step.min() >= -128 and step.max() <= 127)
    return pack(step.astype(np.int8) if small else step)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prefixes(path)
        for batch in batches:
            buf, off = vec.utf8(batch.column(0).field("text"))
            for low, high, b, o in vec.pieces(buf, off, 2 << 20):
                raw = b.tobytes()
                texts = [raw[x:y].decode("utf-8") for x, y in zip(o.tolist(), o[1:].tolist(), strict=False)]
                steps = own.table(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([_narrow(s) for s in steps], pa.binary()), pa.array([int(s.sum()) for s in steps], pa.int64())],
                    ["row", "prefix_counts", "n_tokens"],
                )

    return run


def prefix_counts(documents: DataFrame, path: str) -> DataFrame:
    """``row, prefix_counts, n_tokens``: each row as a struct, the stored counts of every prefix, and the whole count.

    Prefixes end at characters of the text's composed (NFC) form; the count of a
    prefix is what the file's own library gives for it, special strings being
    one token (a prefix that ends inside one counts none of it). A null or empty
    text has no prefix but the empty one, with no token. Repeated rows and other
    columns, whatever their names, come back as they are.
    """
    rows = documents.select(F.struct("*").alias("row"))
    return rows.mapInArrow(_count(path), f"row {rows.schema['row'].dataType.simpleString()}, prefix_counts binary, n_tokens long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _tokens_before(stored: pd.Series, at: pd.Series) -> pd.Series:
    out = []
    for blob, places in zip(stored, at, strict=True):
        counts = np.concatenate([[0], np.cumsum(unpack(blob)[0], dtype=np.int64)])
        out.append(counts[np.clip(np.array(places, np.int64), 0, len(counts) - 1)])
    return pd.Series(out)


def tokens_before(stored: Column, at: Column) -> Column:
    """Token counts of the prefixes of ``at`` (an array of lengths in characters; longer ones are the whole text)."""
    return _tokens_before(stored, at)


@F.pandas_udf(T.LongType())
def _longest_within(stored: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for blob, most in zip(stored, budget, strict=True):
        counts = np.concatenate([[0], np.cumsum(unpack(blob)[0], dtype=np.int64)])
        out.append(int(np.flatnonzero(counts <= most)[-1]) if most >= 0 else 0)
    return pd.Series(out)


def longest_within(stored: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return _longest_within(stored, budget)

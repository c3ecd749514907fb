"""Byte-pair merges on many words at once, and exact decoding, for public tokenizer files."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np

from wardlake.llm import vec

NONE = np.iinfo(np.int32).max
WIDE = 48  # longer words are merged one by one


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + self.suffix] for c in letters], np.int64)
        keys, new = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(ids[left] << 32 | ids[right])
            new.append(ids[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.rank, self.new = order.astype(np.int32), np.array(new, np.int64)[order]
        bytes_of = {c: b for b, c in enumerate(letters)}
        self.size = max(max(ids.values()), *self.special.values(), 0) + 1
        self.spelled: list[bytes] = [b""] * self.size
        self.ends = np.zeros(self.size, bool)
        for token, i in ids.items():
            self.ends[i] = bool(self.suffix) and token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if self.suffix else token
            if all(c in bytes_of for c in body):
                self.spelled[i] = bytes(bytes_of[c] for c in body)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; pairs that never merge have rank NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.new[at]

    def merge(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols (the first ``length`` count) after all merges: lowest rank first, leftmost of these."""
        symbols, length = symbols.copy(), length.copy()
        rows, width = symbols.shape
        if width < 2 or not rows:
            return symbols, length
        rank, new = self._look(symbols[:, :-1], symbols[:, 1:])
        column = np.arange(width)
        rank[column[1:] >= length[:, None]] = NONE
        own = np.arange(rows)
        while True:
            best = rank.argmin(axis=1)
            live = rank[np.arange(len(own)), best] < NONE
            if not live.all():
                rank, new, best, own = rank[live], new[live], best[live], own[live]
            if not len(own):
                return symbols, length
            at = np.arange(len(own))
            moved = column + (column > best[:, None])
            row = np.take_along_axis(symbols[own], np.minimum(moved, width - 1), axis=1)
            row[at, best] = new[at, best]
            symbols[own] = row
            length[own] -= 1
            pairs = np.minimum(column[:-1] + (column[:-1] > best[:, None]), width - 2)
            rank, new = np.take_along_axis(rank, pairs, axis=1), np.take_along_axis(new, pairs, axis=1)
            n = length[own]
            for j in (best - 1, best):
                fits = (j >= 0) & (j + 1 < n)
                k = np.clip(j, 0, width - 2)
                r, made = self._look(row[at, k], row[at, k + 1])
                rank[at[fits], k[fits]], new[at[fits], k[fits]] = r[fits], made[fits]
            rank[column[1:] >= n[:, None]] = NONE

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One long word, in n log n: a heap of pairs over a linked list."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: np.ndarray, j: np.ndarray):
            a, b = np.array([symbols[x] for x in i]), np.array([symbols[x] for x in j])
            rank, new = self._look(a, b)
            for r, x, p, q, made in zip(rank.tolist(), i, a.tolist(), b.tolist(), new.tolist(), strict=True):
                if r < NONE:
                    heapq.heappush(heap, (r, x, p, q, made))

        if n > 1:
            offer(list(range(n - 1)), list(range(1, n)))
        while heap:
            _, i, p, q, made = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != p or j < 0 or symbols[j] != q:
                continue
            symbols[i], symbols[j] = made, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer([i], [right[i]])
            if left[i] >= 0:
                offer([left[i]], [i])
        return [s for s in symbols if s >= 0]

    def encode_words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word of bytes, one word after the other, and how many each has."""
        size = end - start
        count = np.zeros(len(size), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((1, 4), (5, 8), (9, 12), (13, 20), (21, WIDE)):
            own = np.flatnonzero((size >= low) & (size <= high))
            if not len(own):
                continue
            width = int(size[own].max())
            at = np.minimum(start[own][:, None] + np.arange(width), len(buf) - 1)
            symbols = self.first[buf[at]]
            tail = np.arange(len(own)), size[own] - 1
            symbols[tail] = self.last[buf[end[own] - 1]]
            merged, n = self.merge(symbols, size[own])
            count[own] = n
            found.append((own, merged))
        longs = {}
        for i in np.flatnonzero(size > WIDE).tolist():
            symbols = self.first[buf[start[i] : end[i]]]
            symbols[-1] = self.last[buf[end[i] - 1]]
            longs[i] = np.array(self.merge_long(symbols.tolist()), np.int64)
            count[i] = len(longs[i])
        out = np.empty(count.sum(), np.int32)
        at = np.cumsum(count) - count
        for own, merged in found:
            column = np.arange(merged.shape[1])
            inside = column < count[own][:, None]
            out[(at[own][:, None] + column)[inside]] = merged[inside]
        for i, ids in longs.items():
            out[at[i] : at[i] + len(ids)] = ids
        return out, count


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The file at ``path``, read once in each process."""
    return Vocabulary(path)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``flat[start:start + count]`` of all rows, one after the other."""
    total = int(count.sum())
    return flat[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)]


class Decoder:
    """Bytes of id sequences."""

    def __init__(self, path: str):
        spelled = vocabulary(path).spelled
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.count = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.count) - self.count

    def texts(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each row; ids outside the vocabulary are left out, broken UTF-8 is replaced."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.count))
        size = np.where(known, self.count[np.where(known, ids, 0)], 0)
        raw = gather(self.flat, self.start[np.where(known, ids, 0)], size).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[off].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def special_spans(buf: np.ndarray, off: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and id of each special string inside a row; longer strings win where two start together."""
    import re

    if not special:
        return (np.zeros(0, np.int64),) * 3
    pattern = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(special, key=len, reverse=True)))
    raw, found = buf.tobytes(), []
    if any(x.encode() in raw for x in special):
        for a, b in zip(off.tolist(), off[1:].tolist(), strict=False):
            found += [(m.start(), m.end(), special[m[0].decode()]) for m in pattern.finditer(raw, a, b)]
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return vec.names(buf, start, end)

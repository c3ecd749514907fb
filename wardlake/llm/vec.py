"""Text as numpy arrays: whole Arrow columns of UTF-8 bytes, their words and hashes.

Nothing here loops over characters. Working memory is some sixty bytes per byte
of the rows taken at once, so ``pieces`` bounds it by bytes; a single longer
text is taken alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PLAIN = 64  # bytes up to which a run is named by its polynomial
_SEED = 0x5851F42D4C957F2D
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(kind: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse modulo 2**64."""
    have = _powers[kind]
    while len(have) < n:
        step = np.uint64(pow((_BASE, _UNBASE)[kind], len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(buf: np.ndarray, off: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes (or one row): first row, end row, bytes, offsets from 0."""
    low, n = 0, len(off) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(off, off[low] + most, "right")) - 1)
        yield low, high, buf[off[low] : off[high]], off[low : high + 1] - off[low]
        low = high


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``span`` hashes any run of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(0, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run [start, end); equal runs hash alike wherever they stand."""
    low = _power(1, len(sums))[start]
    return mix((sums[end] - sums[start]) * low + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash that stands for each run of bytes.

    Powers modulo 2**64 lose their low bits over long runs: a run of letters and its
    mirror can meet there whatever the base. Runs over ``PLAIN`` bytes are
    therefore hashed by XXH3, byte for byte.
    """
    out = span(prefix(buf), start, end)
    long = np.flatnonzero(end - start > PLAIN)
    if len(long):
        raw = np.ascontiguousarray(buf).data
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], _SEED) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word between ASCII white space."""
    inside = ~SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z in lower case, and its row."""
    start, end, row = words(buf, off)
    return names(LOWER[buf], start, end), row


def shingles(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; a row of fewer words has one, an empty row none."""
    hashes, row = word_hashes(buf, off)
    first = np.searchsorted(row, np.arange(len(off)))  # of each row's words
    count = np.diff(first)
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for t in range(width):
        total += hashes[t : t + n] * np.uint64(pow(_BASE, t + 1, 1 << 64))
    total = mix(total)
    out = []
    for lo, c in zip(first.tolist(), count.tolist(), strict=False):
        if c >= width:
            out.append(np.unique(total[lo : lo + c - width + 1]))
        elif c:
            few = hashes[lo : lo + c] * _power(0, width + 1)[1 : c + 1]
            out.append(mix(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def window_first(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours ``key[i:i+w]``."""
    n = len(key)
    if n < w:
        return key[:0]
    full = -(-n // w) * w
    top = np.iinfo(key.dtype).max
    blocks = np.full(full, top, key.dtype)
    blocks[:n] = key
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])

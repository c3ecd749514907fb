"""Splitting texts into the units byte-pair merges work on, for whole columns at once.

Both splits are those of public tokenizer files, written as rules on runs of
letters, numbers, white space and other characters.
"""

from __future__ import annotations

import functools

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Unicode white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that are units of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by the character tables the tokenizers library has."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))  # no letters or numbers beyond
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            table[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE] = SPACE
    return table


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each begins."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((buf & 0xC0) != 0x80)


def _runs(points: np.ndarray, edge: np.ndarray):
    """Class of each point, and whether it starts a run of its class; ``edge`` marks the first points of rows."""
    kind = classes()[points]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, start


def _endings(points, kind, start, edge, after_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that begin an ending, and the lengths of these units."""
    n = len(points)
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~edge[at + 1]]
    if not after_space:
        at = at[(at == 0) | edge[at] | (points[at - 1] != 32)]
    length = np.zeros(len(at), np.int64)
    for ending in ENDINGS:
        fits = at + len(ending) < n
        for i, letter in enumerate(ending, 1):
            j = np.minimum(at + i, n - 1)
            fits &= (points[j] == ord(letter)) & ~edge[j]
        length[fits & (length == 0)] = len(ending) + 1
    return at[length > 0], length[length > 0]


def spaced(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """First points of units where one space leads the unit after it, and nothing is dropped."""
    kind, start = _runs(points, edge)
    n = len(points)
    last = np.empty(n, bool)  # of a run of white space that something follows in the row
    last[-1:] = False
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:]
    led = np.zeros(n, bool)
    led[1:] = last[:-1] & (points[:-1] == 32)
    first = (start & ~led) | last
    at, length = _endings(points, kind, start, edge, after_space=False)
    for i in range(1, 4):
        j = at[length > i] + i
        first[j] = edge[j]
    after = (at + length)[at + length < n]
    first[after] = True
    return np.flatnonzero(first)


def unspaced(points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end points of units without white space, each number alone; which are endings."""
    kind, start = _runs(points, edge)
    n = len(points)
    first = start | (kind == NUMBER)
    at, length = _endings(points, kind, start, edge, after_space=True)
    for i in range(1, 4):
        first[at[length > i] + i] = False
    after = (at + length)[at + length < n]
    first[after] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    keep = kind[begin] != SPACE
    ending = np.zeros(n + 1, bool)
    ending[at] = True
    return begin[keep], end[keep], ending[begin[keep]]

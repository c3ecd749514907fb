"""A minimal acyclic transducer: words in, token ids out.

States with the same continuations are one state, so suffixes are shared. Every
transition knows how many words come before those it leads to; the sum along a
word is its place among all words, by which its ids are found. All is a handful
of arrays in one file that every process maps read-only.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"WLEX0001"
FIELDS = (("key", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("at", np.int64), ("ids", np.int32))


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of distinct non-empty ``words`` and their ``ids``."""
    order = sorted(range(len(words)), key=words.__getitem__)
    # Incremental construction from sorted words: what lies behind the last
    # word's path never changes again and is replaced by an equal state.
    known: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[list[tuple[int, int]]] = []
    below: list[int] = []

    def settle(is_final: bool, out: list[tuple[int, int]]) -> int:
        name = (is_final, tuple(out))
        if name not in known:
            known[name] = len(final)
            final.append(is_final)
            edges.append(out)
            below.append(is_final + sum(below[t] for _, t in out))
        return known[name]

    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = settle(*path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for i in order:
        word = words[i]
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend((False, []) for _ in word[shared:])
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    root = settle(*path.pop())

    key, target, skip = [], [], []
    for state, out in enumerate(edges):
        before = int(final[state])
        for letter, to in out:
            key.append(state * 256 + letter), target.append(to), skip.append(before)
            before += below[to]
    sizes = np.array([len(ids[i]) for i in order], np.int64)
    arrays = {
        "key": key,
        "target": target,
        "skip": skip,
        "final": final,
        "at": np.concatenate([[0], np.cumsum(sizes)]),
        "ids": [x for i in order for x in ids[i]],
    }
    body, head = b"", [root]
    for name, kind in FIELDS:
        raw = np.asarray(arrays[name], kind).tobytes()
        head += [len(body), len(arrays[name])]
        body += raw + b"\0" * (-len(raw) % 8)
    return MAGIC + np.array(head, np.int64).tobytes() + body


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        head = np.frombuffer(raw, np.int64, 1 + 2 * len(FIELDS), 8).tolist()
        base = 8 + 8 * len(head)
        self.root = head[0]
        for i, (name, kind) in enumerate(FIELDS):
            at, n = head[1 + 2 * i : 3 + 2 * i]
            setattr(self, name, np.frombuffer(raw, kind, n, base + at))

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word of bytes, -1 for words that are not here: all words walk together, byte by byte."""
        out = np.full(len(start), -1, np.int64)
        own = np.arange(len(start))
        state, place, at = np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64), np.asarray(start, np.int64)
        if not len(self.key):
            return out
        while len(own):
            done = at == end[own]
            ended = own[done]
            out[ended] = np.where(self.final[state[done]] > 0, place[done], -1)
            own, state, place, at = (x[~done] for x in (own, state, place, at))
            wanted = state * 256 + buf[at]
            i = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            here = self.key[i] == wanted
            own, i = own[here], i[here]
            state, place, at = self.target[i].astype(np.int64), place[here] + self.skip[i], at[here] + 1
        return out

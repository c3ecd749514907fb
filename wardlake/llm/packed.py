"""Arrays as one compressed piece, for exchanges that would cost far more as rows."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that zstd finds what repeats."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a)]
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.compress(np.array(head, np.int64).tobytes() + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).tolist(), 8 + 24 * n, []
    for i in range(n):
        kind, size, count = head[3 * i : 3 * i + 3]
        plane = np.frombuffer(raw, np.uint8, size * count, at).reshape(size, count)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(f"{chr(kind)}{size}") if count else np.zeros(0, f"{chr(kind)}{size}"))
        at += size * count
    return out


def ranges(ordered: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Part, start and end of each equal range of ascending uint64 hashes that holds any."""
    cuts = np.searchsorted(ordered, np.array([i * (1 << 64) // parts for i in range(1, parts)], np.uint64)).tolist()
    both = zip(range(parts), [0, *cuts], [*cuts, len(ordered)], strict=True)
    return [(p, lo, hi) for p, lo, hi in both if lo < hi]

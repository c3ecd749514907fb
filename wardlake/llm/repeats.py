"""Removal of byte strings that occur twice: sparse suffix runs, merged by known prefixes.

Every byte that lies in a 200-byte string with another occurrence goes. Equal
strings have their least hundred-byte gram (by hash) at the same place, so only
the suffixes that start at such anchors are sorted, about one in fifty bytes.

1. Each document's anchors and the windows each answers for. Anchors whose gram
   occurs once in the corpus answer for no repeat and go no further.
2. The suffixes at the others (200 bytes, then what precedes, backwards) are
   sorted in each task; suffixes equal in all their windows become one. A run is
   front-coded: each suffix has its common prefix with the one before, and a tail.
3. Runs are cut at sampled splitters and exchanged. Each range is merged with a
   loser tree that keeps the common prefix of each waiting suffix with the last
   one out, so bytes known to be equal are never compared again.
4. The merged order and its common prefixes say which windows are equal: same
   right part (common prefix of the suffixes) and same left part (common prefix
   of what precedes). A gram whose suffixes were cut by a splitter, as any gram
   too common for one range is, has its windows counted across ranges instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import vec
from wardlake.llm.packed import pack, ranges, unpack
from wardlake.llm.scratch import Scratch, partitions, small_batches, tidy, tidy_group

LENGTH = 200
GRAM = 100
SPREAD = LENGTH - GRAM  # largest distance from a window's start to its anchor
BITS = 24  # of a position inside a segment
SEGMENT = 4 << 20  # bytes of one document taken at once
RUN = 50_000  # suffixes sorted in memory
TOGETHER = 1 << 19  # anchors of one task that are looked through at once
SAMPLE = 256  # every so many suffixes of a run offer a splitter
KEY = "doc_id long, text_hash long"


# -------------------------------------------------------------------- anchors


def _segments(buf: np.ndarray, off: np.ndarray):
    """Pieces of rows; a very long row comes in overlapping segments: first row, bytes, offsets, base."""
    for low, high, b, o in vec.pieces(buf, off):
        if high - low > 1 or len(b) <= SEGMENT + LENGTH:
            yield low, b, o, 0
        else:
            for base in range(0, len(b) - LENGTH + 1, SEGMENT):
                part = b[base : base + SEGMENT + LENGTH - 1]
                yield low, part, np.array([0, len(part)]), base


def anchors(b: np.ndarray, o: np.ndarray):
    """Gram hash, row, position, least and largest distance from a window's start, for each anchor."""
    n = len(b)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    sums = vec.prefix(b)
    grams = vec.mix((sums[GRAM:] - sums[:-GRAM]) * vec._power(1, n - GRAM + 1))
    low = np.uint64((1 << BITS) - 1)
    least = vec.window_first((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPREAD + 1)
    at = (least & low).astype(np.int64)  # the anchor of each window
    valid = np.repeat(o[1:], np.diff(o))[: len(at)] - np.arange(len(at)) >= LENGTH
    first, last = valid.copy(), valid.copy()
    same = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    first[1:] &= ~same
    last[:-1] &= ~same
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    place = at[first]
    row = np.searchsorted(o, place, "right") - 1
    return grams[place], row, place - o[row], place - last, place - first


def _gather(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, first, n = [], [], 0, 0  # ids, nulls and hashes by batch; anchors; rows and anchors so far

        def flush():
            nonlocal first, n
            if n:
                ids, null, hashes = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield from _settled(ids, null, hashes, [np.concatenate(x) for x in zip(*found, strict=True)], parts)
            rows.clear(), found.clear()
            first = n = 0

        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            rows.append((batch.column(0).fill_null(0).to_numpy(), null, batch.column(1).to_numpy()))
            for low, b, o, base in _segments(*vec.utf8(batch.column(2))):
                gram, row, pos, lo, hi = anchors(b, o)
                found.append((gram, row + low + first, pos + base, lo, hi))
                n += len(gram)
            first += len(batch)
            if n >= TOGETHER:
                yield from flush()
        yield from flush()

    return run


def _settled(ids, null, hashes, found, parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors taken together: what repeats among them by document, the rest packed for each range of grams."""
    order = np.argsort(found[0], kind="stable")
    gram, row, pos, lo, hi = (x[order] for x in found)
    # Grams that repeat here are settled; one entry tells the others.
    again = np.zeros(len(gram), bool)
    again[1:] = gram[1:] == gram[:-1]
    settled = again.copy()
    settled[:-1] |= again[1:]
    known = _by_document(ids, null, hashes, row[settled], pos[settled], lo[settled], hi[settled])
    n = len(known)
    if n:
        part = pa.array(np.arange(n) % parts, pa.int32())
        yield pa.RecordBatch.from_arrays([part, *(c.combine_chunks() for c in known.columns)], ["part", "doc_id", "text_hash", "blob"])
    keep = ~again
    gram, row, pos, lo, hi, settled = (x[keep] for x in (gram, row, pos, lo, hi, settled))
    out = []
    for part, s, e in ranges(gram, parts):
        own, index = np.unique(row[s:e], return_inverse=True)
        deltas = np.diff(gram[s:e], prepend=np.uint64(0))
        where = (index.astype(np.uint32), pos[s:e].astype(np.uint32), lo[s:e].astype(np.uint8), hi[s:e].astype(np.uint8))
        out.append((part, pack(deltas, settled[s:e], *where, ids[own], null[own], hashes[own])))
    nothing = pa.nulls(len(out), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int32()), nothing, nothing, pa.array([x[1] for x in out], pa.binary())],
        ["part", "doc_id", "text_hash", "blob"],
    )


def _by_document(ids, null, hashes, which, *columns) -> pa.Table:
    """A row for each document of ``which``, its entries of ``columns`` packed."""
    order = np.argsort(which, kind="stable")
    own, start = np.unique(which[order], return_index=True)
    columns = [c[order] for c in columns]
    ends = [*start[1:].tolist(), len(order)] if len(order) else []
    blobs = [pack(*(c[s:e] for c in columns)) for s, e in zip(start.tolist(), ends, strict=True)]
    return pa.table({"doc_id": pa.array(ids[own], pa.int64(), mask=null[own]), "text_hash": pa.array(hashes[own], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _repeated(pieces: pa.Table) -> pa.Table:
    """Anchors of the grams that occur more than once, by document."""
    settled = pieces.filter(pc.is_valid(pieces["text_hash"])).select(["doc_id", "text_hash", "blob"])
    parts, base = [], 0
    for blob in pieces.filter(pc.is_null(pieces["text_hash"]))["blob"]:
        gram, known, index, *rest = unpack(blob.as_py())
        parts.append((np.cumsum(gram, dtype=np.uint64), known, index.astype(np.int64) + base, *rest))
        base += len(rest[3])
    if not parts:
        return settled
    gram, known, index, pos, lo, hi, ids, null, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    again = np.zeros(len(gram), bool)
    again[1:] = gram[order][1:] == gram[order][:-1]
    again[:-1] |= again[1:]
    keep = order[again]
    keep = keep[~known[keep]]
    return pa.concat_tables([settled, _by_document(ids, null, hashes, index[keep], pos[keep], lo[keep], hi[keep])])


# ----------------------------------------------------------------------- runs


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two suffixes that agree on ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def front_code(keys: list[bytes]) -> list[int]:
    """Common prefix of each key with the one before."""
    out, last = [], b""
    for key in keys:
        out.append(common(last, key, 0))
        last = key
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Key, common prefix with the key before, run and place, in order: a loser tree on sorted runs.

    Each waiting key carries its common prefix with the last key out. Of two, the
    longer one's key is the smaller without a look at its bytes; only on a tie are
    bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k  # of each run's head with the last key out
    loser = [0] * k

    def less(a: int, b: int) -> bool:
        """Whether run a's head goes first; the loser's prefix becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        p, q = prefix[a], prefix[b]
        if p != q:
            return p > q
        n = common(x, y, p)
        first = x[n:] <= y[n:] if n < len(x) and n < len(y) else len(x) <= len(y)
        prefix[b if first else a] = n
        return first

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], loser[node] = (a, b) if less(a, b) else (b, a)
    at = winners[1]
    while (key := heads[at]) is not None:
        yield key, prefix[at], at, place[at]
        keys, coded = runs[at]
        place[at] += 1
        if place[at] < len(keys):
            heads[at], prefix[at] = keys[place[at]], coded[place[at]]
        else:
            heads[at] = None
        node = (k + at) >> 1
        while node:
            other = loser[node]
            if not less(at, other):
                loser[node], at = at, other
            node >>= 1


RUNS = "doc_id long, text_hash long, spans binary, run binary, sample array<binary>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    ids, hashes = [], []

    def flush():
        if not held:
            return
        entries = sorted(held.items())
        keys = [key for (key, *_), _ in entries]
        coded = front_code(keys)
        members = [len(m) for _, m in entries]
        docs = np.array([d for _, m in entries for d, _ in m], np.int64)
        pos = np.array([p for _, m in entries for _, p in m], np.int64)
        lo, hi = (np.array([e[0][i] for e in entries], np.uint8) for i in (2, 3))
        many = np.repeat(np.array(members) > 1, members)
        null = np.array([x is None for x in ids])
        number, hashed = np.array([x or 0 for x in ids], np.int64), np.array(hashes, np.int64)
        # What has an equal in this run is repeated in all its windows.
        low, high = np.repeat(lo, members).astype(np.int64), np.repeat(hi, members).astype(np.int64)
        done = _by_document(number, null, hashed, docs[many], (pos - high)[many], (pos - low + LENGTH)[many])
        for row in done.to_batches():
            yield _run_rows(doc_id=row.column(0), text_hash=row.column(1), spans=row.column(2))
        first = np.cumsum([0, *members[:-1]])
        run = pack(
            np.array(coded, np.uint16),
            np.array([len(x) for x in keys], np.uint16),
            np.frombuffer(b"".join(key[n:] for key, n in zip(keys, coded, strict=True)), np.uint8),
            np.array([len(e[0][1]) for e in entries], np.uint8),
            np.frombuffer(b"".join(e[0][1] for e in entries), np.uint8),
            lo,
            hi,
            np.array(members) > 1,
            number[docs[first]],
            null[docs[first]],
            hashed[docs[first]],
            pos[first],
        )
        yield _run_rows(run=pa.array([run], pa.binary()), sample=pa.array([keys[SAMPLE // 2 :: SAMPLE]], pa.list_(pa.binary())))
        held.clear(), ids.clear(), hashes.clear()

    for batch in batches:
        raw, off = vec.utf8(batch.column(2))
        for i, blobs in enumerate(batch.column(3).to_pylist()):
            text = raw[off[i] : off[i + 1]].tobytes()
            doc = len(ids)
            ids.append(batch.column(0)[i].as_py()), hashes.append(batch.column(1)[i].as_py())
            for blob in blobs:
                for p, lo, hi in zip(*(x.tolist() for x in unpack(blob)), strict=True):
                    # Filling up with zeros is safe: no window reaches past the text's end.
                    left = text[max(0, p - SPREAD) : p][::-1]
                    key = text[p : p + LENGTH].ljust(LENGTH, b"\0") + left
                    held.setdefault((key, left, lo, hi), []).append((doc, p))
            if len(held) >= RUN:
                yield from flush()
    yield from flush()


RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.binary()), ("run", pa.binary()), ("sample", pa.list_(pa.binary()))])


def _run_rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in RUN_SCHEMA], schema=RUN_SCHEMA)


# ---------------------------------------------------------------------- merge


def _entries(blob: bytes) -> tuple:
    coded, lengths, tails, left_n, lefts, *rest = unpack(blob)
    tails, lefts, keys, left, at, last, from_ = tails.tobytes(), lefts.tobytes(), [], [], 0, b"", 0
    for n, size, m in zip(coded.tolist(), lengths.tolist(), left_n.tolist(), strict=True):
        last = last[:n] + tails[at : at + size - n]
        at += size - n
        keys.append(last)
        left.append(lefts[from_ : from_ + m])
        from_ += m
    return keys, coded.tolist(), left, rest


def _cut(splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        for batch in batches:
            for blob in batch.column(0):
                keys, coded, left, rest = _entries(blob.as_py())
                cuts = [bisect_left(keys, s) for s in splitters.value]
                for part, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
                    if s < e:
                        n = [0, *coded[s + 1 : e]]
                        piece = pack(
                            np.array(n, np.uint16),
                            np.array([len(x) for x in keys[s:e]], np.uint16),
                            np.frombuffer(b"".join(key[m:] for key, m in zip(keys[s:e], n, strict=True)), np.uint8),
                            np.array([len(x) for x in left[s:e]], np.uint8),
                            np.frombuffer(b"".join(left[s:e]), np.uint8),
                            *(x[s:e] for x in rest),
                        )
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.binary())], ["part", "blob"])

    return run


def equal_windows(prefixes: np.ndarray, lefts: list[bytes], lo: np.ndarray, hi: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For sorted suffixes: whether the window that starts s bytes before has an equal, for s = 0 .. SPREAD.

    ``prefixes`` are common prefixes with the suffix before, ``lefts`` what
    precedes each, backwards. Suffixes with less than a gram in common share no
    window that both answer for.
    """
    n = len(prefixes)
    out = np.zeros((n, SPREAD + 1), bool)
    if not n:
        return out
    group = np.cumsum(prefixes < GRAM)
    padded = np.frombuffer(b"".join(x.ljust(SPREAD, b"\0") for x in lefts), np.uint8).reshape(n, SPREAD)
    order = np.lexsort((padded.view(f"S{SPREAD}").ravel(), group))
    differ = padded[order][1:] != padded[order][:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), SPREAD)
    left_new = np.full(n, -1)
    left_new[1:] = np.where(group[order][1:] == group[order][:-1], shared, -1)
    weight = np.where(many, 2, 1)
    for s in range(SPREAD + 1):
        own = np.flatnonzero((lo <= s) & (s <= hi))
        if len(own):
            left = np.empty(n, np.int64)
            left[order] = np.cumsum(left_new < s)
            name = np.cumsum(prefixes < LENGTH - s)[own] * (n + 1) + left[own]
            _, which = np.unique(name, return_inverse=True)
            out[own, s] = np.bincount(which, weights=weight[own])[which] >= 2
    return out


def _spans(windows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, start and end of each run of windows."""
    edge = np.zeros((len(windows), SPREAD + 3), np.int8)
    edge[:, 1:-1] = windows
    step = np.diff(edge, axis=1)
    entry, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return entry, pos[entry] - after + 1, pos[entry] - first + LENGTH


MERGED = "doc_id long, text_hash long, spans binary, window binary, start long, copies int"
MERGED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.binary()), ("window", pa.binary()), ("start", pa.int64()), ("copies", pa.int32())])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, at most ``LENGTH``."""
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, LENGTH) != np.frombuffer(b, np.uint8, LENGTH))
    return int(differ[0]) if len(differ) else LENGTH


def _merged(splitters):
    """Settles the windows of one range.

    Equal windows follow the same right part, and suffixes with a common prefix
    are neighbours but for a splitter between them. So a window may have an equal in
    another range only if its right part is that of a splitter beside this range; of
    those, one row for each different window tells the other ranges that it is here.
    """

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        part, bounds = key[0].as_py(), splitters.value
        beside = [bounds[i] for i in (part - 1, part) if 0 <= i < len(bounds)]
        grams = {x[:GRAM] for x in beside}
        runs = [_entries(x.as_py()) for x in pieces["blob"]]
        prefixes, source, place, keys = [], [], [], []
        for suffix, known, at, where in merge([(r[0], r[1]) for r in runs]):
            prefixes.append(known), source.append(at), place.append(where)
            keys.append(suffix if suffix[:GRAM] in grams else None)
        base = np.cumsum([0, *(len(r[0]) for r in runs)])
        flat = base[np.array(source, np.int64)] + np.array(place, np.int64)
        lo, hi, many, ids, null, hashes, pos = (np.concatenate([r[3][i] for r in runs])[flat] for i in range(7))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        lefts = [runs[a][2][b] for a, b in zip(source, place, strict=True)]
        prefixes = np.array(prefixes, np.int64)
        prefixes[0] = 0

        shared = prefixes >= GRAM
        near = shared.copy()
        near[:-1] |= shared[1:]
        inside = np.flatnonzero(near)  # others are alone with their gram: nothing to compare
        windows = equal_windows(prefixes[inside], [lefts[i] for i in inside.tolist()], lo[inside], hi[inside], many[inside])
        windows &= ~many[inside][:, None]  # their spans are out already
        entry, start, end = _spans(windows, pos[inside])
        found = _by_document(ids, null, hashes, inside[entry], start, end) if len(entry) else None
        out = []
        if found is not None:
            n = len(found)
            columns = [found["doc_id"].combine_chunks(), found["text_hash"].combine_chunks(), found["blob"].combine_chunks()]
            out.append(pa.Table.from_arrays([*columns, *(pa.nulls(n, f.type) for f in list(MERGED_SCHEMA)[3:])], schema=MERGED_SCHEMA))
        told: dict[bytes, list] = {}  # different windows that another range may hold: copies here, and the first
        for i, right in enumerate(keys):
            if right is None:
                continue
            left, reach = lefts[i][::-1], max(_common(right, x) for x in beside)
            for s in range(max(int(lo[i]), LENGTH - reach), int(hi[i]) + 1):
                seen = told.setdefault(xxhash.xxh3_128_digest(left[len(left) - s :] + right[: LENGTH - s]), [0, i, int(pos[i]) - s])
                seen[0] += 2 if many[i] else 1
        if told:
            copies, at, begin = (np.array(x) for x in zip(*told.values(), strict=True))
            settled = copies > 1  # their spans are out: only the window itself counts elsewhere
            out.append(
                pa.Table.from_arrays(
                    [
                        pa.array(ids[at], pa.int64(), mask=null[at] | settled),
                        pa.array(hashes[at], pa.int64()),
                        pa.nulls(len(at), pa.binary()),
                        pa.array(list(told), pa.binary()),
                        pa.array(begin, pa.int64(), mask=settled),
                        pa.array(np.minimum(copies, 2), pa.int32()),
                    ],
                    schema=MERGED_SCHEMA,
                )
            )
        return pa.concat_tables(out) if out else MERGED_SCHEMA.empty_table()

    return run


# --------------------------------------------------------------------- result


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = vec.utf8(batch.column(0).field("text"))
        kept, spans = [], []
        for i, blobs in enumerate(batch.column(1).to_pylist()):
            text = raw[off[i] : off[i + 1]]
            if not blobs:
                kept.append(text.tobytes()), spans.append([])
                continue
            start, end = (np.concatenate(x) for x in zip(*(unpack(b) for b in blobs), strict=True))
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, start, 1), np.add.at(depth, end, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept.append(text[~gone].tobytes())
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["row", "kept", "spans"],
        )


def _joined(documents: DataFrame) -> DataFrame:
    """``row, spans``: each row and the packed ranges that go."""
    spark = documents.sparkSession
    scratch, parts = Scratch(spark), partitions(spark)
    text = F.coalesce("text", F.lit(""))
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    docs = documents.select(*key, text.alias("text"))

    gathered = docs.mapInArrow(tidy(_gather(parts)), f"part int, {KEY}, blob binary")
    repeated = gathered.groupBy("part").applyInArrow(tidy_group(lambda _, pieces: _repeated(pieces)), f"{KEY}, blob binary")
    by_doc = repeated.groupBy("doc_id", "text_hash").agg(F.collect_set("blob").alias("anchors"))
    same = "d.doc_id <=> a.doc_id AND d.text_hash = a.text_hash"
    marked = docs.alias("d").join(by_doc.alias("a"), F.expr(same))
    with small_batches(spark):  # whole texts
        runs = scratch.keep("runs", marked.select("d.doc_id", "d.text_hash", "d.text", "a.anchors").mapInArrow(tidy(_runs), RUNS))

    offered = runs.select(F.explode("sample").alias("key"))
    n = runs.agg(F.sum(F.size("sample"))).first()[0] or 0
    thin = max(1, n // (32 * parts))  # about 32 keys a range reach the driver
    keys = sorted(bytes(r[0]) for r in offered.where(F.expr(f"pmod(xxhash64(key), {thin}) = 0")).collect())
    chosen = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    splitters = spark.sparkContext.broadcast(chosen)
    pieces = runs.where("run IS NOT NULL").select("run").mapInArrow(tidy(_cut(splitters)), "part int, blob binary")
    merged = scratch.keep("merged", pieces.groupBy("part").applyInArrow(tidy_group(_merged(splitters)), MERGED))

    windows = merged.where("window IS NOT NULL")
    twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    across = windows.where("start IS NOT NULL").join(twice, "window").select("doc_id", "text_hash", "start")
    spans = (
        runs.where("spans IS NOT NULL").select("doc_id", "text_hash", "spans")
        .union(merged.where("spans IS NOT NULL").select("doc_id", "text_hash", "spans"))
        .union(across.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts")).mapInArrow(_as_spans, f"{KEY}, spans binary"))
    )
    gone = spans.groupBy("doc_id", "text_hash").agg(F.collect_list("spans").alias("spans"))
    rows = documents.select(*key, F.struct("*").alias("row"))
    return rows.alias("d").join(gone.alias("a"), F.expr(same), "left").select("d.row", "a.spans")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``row, kept, spans``: each row of ``documents`` with what is left of its text and what went.

    ``row`` is the whole input row as a struct, ``kept`` the remaining bytes and
    ``spans`` the maximal removed byte ranges, ascending. A null text is empty; a
    text of under 200 bytes loses nothing. Rows with equal id and text are
    occurrences of their own, so each removes the other; a null id is an id.
    Other columns, whatever their names, come back inside ``row``.
    """
    joined = _joined(documents)
    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept binary, spans array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(tidy(_apply), schema)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _apply(batches):
        row = batch.column(0)
        there = row.field("text").is_valid().to_pylist()
        # A character that lost a part of its bytes goes as a whole.
        texts = [k.decode("utf-8", "ignore") if t else None for k, t in zip(batch.column(1).to_pylist(), there, strict=True)]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        fields = [f.name for f in row.type]
        columns = [new[n].cast(row.type.field(n).type) if n in new else row.field(n) for n in fields]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields)], ["row"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated parts cut out of ``text`` (and ``n_chars``, if there, counted anew)."""
    joined = _joined(documents)
    return joined.mapInArrow(tidy(_rewrite), f"row {joined.schema['row'].dataType.simpleString()}").select("row.*")


def _as_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
        blobs = pa.array([pack(x, x + LENGTH) for x in starts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs], ["doc_id", "text_hash", "spans"])

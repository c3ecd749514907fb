"""Near-duplicate join: adaptive multi-match prefixes on word shingles.

A document is the set of its five-word shingles; two link at a Jaccard
similarity of 0.8 or more. Shingles are ordered rare first. Of a set of ``n``,
any partner shares ``o = ceil(0.8 n)`` or more, so the first ``n - o + l``
shingles of two linked sets share ``l`` at least. Each document chooses its own
``l`` where the estimated cost (entries scanned, candidates verified) is least; a
pair is verified when it shares the smaller ``l`` of the two. Any order and any
estimates give the same result.

Before any text moves, a pair is tried on sketches: for each set a bit per
shingle or so, the parity of its shingles there. Every bit in which two sketches
differ stands for a shingle that one set has alone, which bounds the overlap from
above; pairs that the bound rules out cannot link. Only texts of the others are
exchanged (a bitmap of fixed size says which those may be).

Equal sets are one node. Two rounds find the links that connect everything.
First every member of a prefix shingle's bucket is compared with the bucket's
hub, the member with most shared prefix shingles; that is linear, and joins a
group of near copies at once. Then come pairs that are still in different
components, as pairs already connected need no check: in a small bucket all of
them, counted over shingles. In a larger one both have known overlaps with its
hub ``h``, and ``|x & y| <= min(|x & h|, |y & h|) + |(x - h) & (y - h)|``. So a
linked pair has enough in common with the hub on both sides, or shares some of
the rarest shingles it has outside the hub; only such pairs are verified, and
copies that differ from the hub each in their own way are never paired.

The order comes from a sketch of shingle frequencies over all documents, of
fixed size. Shingles it calls frequent go through Spark rows whose joins split
a hot key; the others have at most ``HOT`` entries and travel packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import vec
from wardlake.llm.components import components
from wardlake.llm.exact import among, bitmap_of
from wardlake.llm.scratch import Scratch, partitions, small_batches, tidy

WIDTH, PERCENT = 5, 80
SLOTS = 1 << 21  # counters of the sketch: 16 MB whatever the input
BLOCKS = 16
MOST_MATCHES = 8  # largest l
HOT = 4096  # estimated documents of a shingle from which it is not packed
FLUSH = 1 << 20  # prefix entries packed at once
SMALL = 32  # members of a bucket that are paired without their hub
STEP = 1 << 20  # bytes of texts that are compared at once


def overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


# ---------------------------------------------------------------- frequencies


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        buf, off = vec.utf8(batch.column(0))
        for _, _, b, o in vec.pieces(buf, off):
            for found in vec.shingles(b, o, WIDTH):
                counts[found & np.uint64(SLOTS - 1)] += 1  # few of one document share a counter
    packed = [zstandard.compress(part.tobytes(), 1) for part in np.split(counts, BLOCKS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def _add(batches: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in batches["counts"])
    return pa.table({"block": batches["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def sketch(documents: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each slot, over all documents; an upper estimate for each shingle."""
    schema = "block int, counts binary"
    parts = documents.select("text").mapInArrow(tidy(_count), schema).groupBy("block").applyInArrow(_add, schema)
    out = np.zeros(SLOTS, np.int64)
    for row in parts.collect():  # BLOCKS rows
        out.reshape(BLOCKS, -1)[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out if out.max(initial=0) >= 1 << 32 else out.astype(np.uint32)


# ------------------------------------------------------------------- sketches


def parity(found: np.ndarray) -> bytes:
    """A bit for each shingle or half of one: the parity of the shingles that fall on it."""
    width = 1 << max(6, (len(found) - 1).bit_length())
    bits = np.bincount(((found >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many shingles only one of two sets has, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # a sketch folds into one of half its width
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link: not ruled out by size or sketch."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
        far = np.array([apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
        most = np.minimum((n + m - far) // 2, np.minimum(n, m))
        yield batch.select([0, 1]).filter(pa.array(100 * most >= PERCENT * (n + m - most)))


# ------------------------------------------------------------------- prefixes


def choose(found: np.ndarray, counts: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of an ascending set, rare shingles first, their estimates, and the matches it asks for."""
    estimate = counts[found & np.uint64(SLOTS - 1)]
    n, need = len(found), overlap(len(found))
    longest = min(MOST_MATCHES, need)
    order = np.argsort(estimate, kind="stable")[: n - need + longest]
    others = np.maximum(estimate[order].astype(np.float64) - usual, 0)
    scanned, matches = np.cumsum(others), np.arange(1, longest + 1)
    ends = n - need + matches - 1
    cost = scanned[ends] + matches + n / 8 * scanned[ends] / matches
    best = int(np.argmin(cost))
    order = order[: ends[best] + 1]
    return found[order], estimate[order], best + 1


def _pack(tokens: np.ndarray, nodes: np.ndarray, names: list[bytes], sizes: np.ndarray, ells: np.ndarray, parts: int):
    """A packed piece for each range of tokens."""
    order = np.argsort(tokens)
    tokens, nodes = tokens[order], nodes[order]
    cuts = np.searchsorted(tokens, np.array([i * (1 << 64) // parts for i in range(1, parts)], np.uint64)).tolist()
    for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(tokens)], strict=True)):
        if lo < hi:
            own, index = np.unique(nodes[lo:hi], return_inverse=True)
            head = np.array([hi - lo, len(own)], np.int64).tobytes()
            deltas = np.diff(tokens[lo:hi], prepend=np.uint64(0))
            body = deltas.view(np.uint8).reshape(-1, 8).T.tobytes() + index.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
            meta = b"".join(names[i] for i in own.tolist()) + sizes[own].tobytes() + ells[own].tobytes()
            yield part, zstandard.compress(head + body + meta, 1)


def _unpack(blob: bytes):
    raw = zstandard.decompress(blob)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    tokens = np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)
    at += 8 * n
    index = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view(np.uint32).ravel()
    at += 4 * n
    names = np.frombuffer(raw, "V16", k, at)
    at += 16 * k
    return tokens, index, names, np.frombuffer(raw, np.int32, k, at), np.frombuffer(raw, np.int32, k, at + 4 * k)


NODE = pa.schema(
    [("doc_id", pa.int64()), ("tie", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("l", pa.int32()), ("token", pa.int64()), ("part", pa.int32()), ("blob", pa.binary()), ("sketch", pa.binary())]
)


def _signer(counts, parts: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        usual = table.mean()
        tokens, nodes, names, sizes, ells, seen = [], [], [], [], [], 0

        def flush():
            nonlocal seen
            if seen:
                packed = list(_pack(np.concatenate(tokens), np.concatenate(nodes), names, np.array(sizes, np.int32), np.array(ells, np.int32), parts))
                yield pa.RecordBatch.from_pylist([{"part": p, "blob": b} for p, b in packed], NODE)
            for held in (tokens, nodes, names, sizes, ells):
                held.clear()
            seen = 0

        for batch in batches:
            ids, ties, (buf, off) = batch.column(0), batch.column(1), vec.utf8(batch.column(2))
            for low, high, b, o in vec.pieces(buf, off):
                rows, hot = {"node": [], "n": [], "l": [], "sketch": []}, {"node": [], "n": [], "l": [], "token": []}
                for found in vec.shingles(b, o, WIDTH):
                    if not len(found):
                        rows["node"].append(None), rows["n"].append(0), rows["l"].append(0), rows["sketch"].append(None)
                        continue
                    name = xxhash.xxh3_128_digest(found.tobytes())
                    chosen, estimate, ell = choose(found, table, usual)
                    rows["node"].append(name), rows["n"].append(len(found)), rows["l"].append(ell), rows["sketch"].append(parity(found))
                    many = estimate >= HOT + usual
                    for token in chosen[many].view(np.int64).tolist():
                        hot["node"].append(name), hot["n"].append(len(found)), hot["l"].append(ell), hot["token"].append(token)
                    few = chosen[~many]
                    tokens.append(few), nodes.append(np.full(len(few), len(names), np.uint32))
                    names.append(name), sizes.append(len(found)), ells.append(ell)
                    seen += len(few)
                yield _rows({"doc_id": ids[low:high], "tie": ties[low:high], **rows})
                if hot["token"]:
                    yield _rows(hot)
                if seen >= FLUSH:
                    yield from flush()
        yield from flush()

    return sign


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(columns["node"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in NODE], schema=NODE
    )


def _shared(pieces: pa.Table) -> pa.Table:
    """Entries of the tokens that more than one node of the part has."""
    tokens, index, names, sizes, ells, base = [], [], [], [], [], 0
    for blob in pieces["blob"]:
        t, i, name, n, ell = _unpack(blob.as_py())
        tokens.append(t), index.append(i.astype(np.int64) + base), names.append(name), sizes.append(n), ells.append(ell)
        base += len(name)
    names, sizes, ells = np.concatenate(names), np.concatenate(sizes), np.concatenate(ells)
    own, first, same = np.unique(names, return_index=True, return_inverse=True)
    token, node = np.concatenate(tokens), same[np.concatenate(index)]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    again[:-1] |= again[1:]
    token, node = token[again], node[again]
    return pa.table(
        {
            "token": pa.array(token.view(np.int64)),
            "node": pa.array([x.tobytes() for x in own[node]], pa.binary()),
            "n": pa.array(sizes[first][node], pa.int32()),
            "l": pa.array(ells[first][node], pa.int32()),
        }
    )


# --------------------------------------------------------------- verification


PAIRS = "a binary, b binary, n_a int, n_b int, both int, outside array<long>"


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of some ``STEP`` bytes of texts, told from the frames' heads; a longer pair is taken alone."""
    size = [sum(zstandard.get_frame_parameters(batch.column(c)[i].as_buffer()[:18]).content_size for c in (2, 3)) for i in range(len(batch))]
    ends, lo = np.cumsum(size), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _compare(counts, beyond: bool):
    """Sizes and overlap of each pair and, if ``beyond``, the rarest shingles of ``b`` outside ``a`` that a partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value if beyond else None
        for batch in (step for whole in batches for step in _steps(whole)):
            sizes, outside = [], []
            texts = (vec.utf8(pa.array([zstandard.decompress(x) for x in batch.column(c).to_pylist()], pa.large_binary())) for c in (2, 3))
            for x, y in zip(*[vec.shingles(buf, off, WIDTH) for buf, off in texts], strict=True):
                rest = np.setdiff1d(y, x, assume_unique=True)
                both = len(y) - len(rest)
                sizes.append((len(x), len(y), both))
                if beyond:
                    need = max(1, overlap(len(y)) - both)
                    order = np.argsort(table[rest & np.uint64(SLOTS - 1)], kind="stable")[: len(rest) - need + 1]
                    outside.append(rest[order].view(np.int64))
            numbers = np.array(sizes, np.int32).reshape(-1, 3)
            more = pa.array(outside, pa.list_(pa.int64())) if beyond else pa.nulls(len(batch), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(numbers[:, j]) for j in range(3)), more],
                ["a", "b", "n_a", "n_b", "both", "outside"],
            )

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([zstandard.compress(x.encode(), 1) for x in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "tie", "text"])


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``pairs`` (``a, b``) that sizes and sketches do not rule out."""
    left, right = (marks.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return both.where(_close("n_a", "n_b")).mapInArrow(_possible, "a binary, b binary")


def _compared(pairs: DataFrame, texts: DataFrame, counts, scratch: Scratch, name: str, beyond: bool = False) -> DataFrame:
    """``pairs`` (``a, b``) with what `_compare` finds; only texts that a pair may need are exchanged."""
    pairs = scratch.keep(f"{name}-pairs", pairs)
    bitmap = scratch.keep(f"{name}-bitmap", bitmap_of(pairs.select(F.col("a").alias("hash")).union(pairs.select("b"))))
    asked = among(texts.withColumnRenamed("node", "hash"), bitmap)
    left = asked.select(F.col("hash").alias("a"), F.col("text").alias("text_a"))
    right = asked.select(F.col("hash").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(_compare(counts, beyond)), PAIRS)


def _named(doc_id: str, tie: str):
    """A text's place in a bitmap: ids may be null, and texts may share one."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(0)), tie)


SIMILAR = f"100 * both >= {PERCENT} * (n_a + n_b - both)"


def _close(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


# ----------------------------------------------------------------------- join


def _joined(documents: DataFrame) -> DataFrame:
    with small_batches(documents.sparkSession):
        return _linked(documents)


def _linked(documents: DataFrame) -> DataFrame:
    """``doc_id, tie, n, node, root, component`` of each row.

    ``tie`` is a hash of its text, ``node`` its set and ``root`` the first node
    of its component; rows with one id can be in several.
    """
    spark = documents.sparkSession
    scratch, parts = Scratch(spark), partitions(spark)
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tie, "text")
    counts = spark.sparkContext.broadcast(sketch(docs))
    signed = scratch.keep(
        "signed",
        docs.mapInArrow(tidy(_signer(counts, parts)), "doc_id long, tie long, node binary, n int, l int, token long, part int, blob binary, sketch binary"),
    )
    rows = scratch.keep("rows", signed.where("token IS NULL AND blob IS NULL").select("doc_id", "tie", "node", "n", "sketch"))
    entry = "token long, node binary, n int, l int"
    packed = signed.where("blob IS NOT NULL").select("part", "blob").groupBy("part").applyInArrow(_shared, entry)
    hot = signed.where("token IS NOT NULL").select("token", "node", "n", "l").distinct()
    entries = scratch.keep("entries", packed.union(hot))
    scratch.drop("signed")

    # One text stands for each node that shares a prefix shingle with another. An id
    # (null is one) does not name a text, as rows may repeat it; id and tie do.
    degree = scratch.keep("degree", entries.groupBy("node").agg(F.count("*").alias("degree")))
    shared = degree.select("node")
    counted = rows.join(shared, "node", "left_semi").groupBy("node", "doc_id", "tie", "n", "sketch").agg(F.count("*").alias("copies"))
    first = counted.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "copies", "n", "sketch")).alias("first"))
    chosen = scratch.keep("chosen", first.select("node", *(F.col(f"first.{c}").alias(f"of_{c}") for c in ("doc_id", "tie", "copies")), "first.n", "first.sketch"))
    marks = chosen.select("node", "n", "sketch")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("tie") == F.col("of_tie"))
    # A bitmap of the texts that stand for one rules most others out before they are packed and moved.
    standing = scratch.keep("standing", bitmap_of(chosen.select(_named("of_doc_id", "of_tie").alias("hash"))))
    asked = among(docs.where("text IS NOT NULL").withColumn("hash", _named("doc_id", "tie")), standing).select("doc_id", "tie", "text")
    small = asked.mapInArrow(tidy(_compress), "doc_id long, tie long, text binary")
    stands = small.join(chosen.select("node", "of_doc_id", "of_tie"), same).select("node", "text")
    if not chosen.where("of_copies > 1").isEmpty():  # else no text comes twice
        stands = stands.dropDuplicates(["node"])
    texts = scratch.keep("texts", stands)

    first = entries.join(degree, "node").groupBy("token").agg(
        F.max(F.struct("degree", "node", "n")).alias("first"), F.count("*").alias("members")
    )
    hubs = scratch.keep("hubs", first.select("token", "members", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n")))
    hubbed = entries.drop("l").join(hubs.drop("members"), "token")
    pairs = hubbed.where("node <> hub").where(_close("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    checked = scratch.keep("checked", _compared(_likely(pairs, marks), texts, counts, scratch, "hub").drop("outside"))
    roots = scratch.keep("roots-1", components(checked.where(SIMILAR).select("a", "b"), scratch))

    # Entries move without their hub: only the larger of the buckets that stay open need it.
    named = scratch.keep("named", entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    scratch.drop("entries", "degree")
    sizes = named.groupBy("token", "root").agg(F.count("*").alias("held"))
    main = sizes.groupBy("token").agg(F.max(F.struct("held", "root")).alias("main"), F.count("*").alias("roots"), F.sum("held").alias("members"))
    several = main.where("roots > 1").select("token", "members", F.col("main.root").alias("main"))
    open_ = scratch.keep("open", named.join(several, "token"))
    scratch.drop("named")

    def across(rows: DataFrame, key: str, others: str = "true"):
        """Pairs of different components that share ``key``, once each."""
        x, y = rows.where("root <> main").alias("x"), rows.alias("y")
        once = f"x.{key} = y.{key} AND x.root <> y.root AND (y.root = y.main OR x.node < y.node) AND {others}"
        return x.join(y, F.expr(once)).where(_close("x.n", "y.n")).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.l", "y.l").alias("l")
        )

    few = across(open_.where(F.col("members") <= SMALL), "token").groupBy("a", "b").agg(F.count("*").alias("matches"), F.first("l").alias("l"))
    # Larger buckets that are still open: here overlaps with the hub are needed, of all members.
    large = open_.where(F.col("members") > SMALL).join(hubs.where(F.col("members") > SMALL).select("token", "hub"), "token")
    asked = large.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    known = scratch.keep("known", _compared(asked, texts, counts, scratch, "large", beyond=True))
    known = known.select(F.col("a").alias("hub"), F.col("b").alias("node"), "both", "outside")
    held = scratch.keep("held", large.where("node = hub").select("token", "node", "n", "l", "root", "main", "hub", F.col("n").alias("both")).unionByName(
        large.join(known.drop("outside"), ["hub", "node"]).select("token", "node", "n", "l", "root", "main", "hub", "both")
    ))
    # Whatever the partner's size, a pair inside the hub needs 4/5 of each in it.
    inside = across(held.where(f"100 * both >= {PERCENT} * n"), "token", f"{100 + PERCENT} * least(x.both, y.both) >= {PERCENT} * (x.n + y.n)")
    beside = (
        held.groupBy("hub", "node").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.first("root").alias("root"))
        .join(known, ["hub", "node"])
        .select("node", "n", "l", "root", F.lit(None).cast("binary").alias("main"), F.explode("outside").alias("token"), "hub")
        .select("node", "n", "l", "root", "main", F.xxhash64("hub", "token").alias("place"))
    )
    place = scratch.keep("place", beside)
    again = place.groupBy("place").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("place", F.col("most").alias("main"))
    outside = across(place.drop("main").join(again, "place"), "place")
    candidates = few.where("matches >= l").select("a", "b").union(inside.select("a", "b")).union(outside.select("a", "b")).distinct()
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untried = _likely(candidates.join(done, ["a", "b"], "left_anti"), marks)
    more = _compared(untried, texts, counts, scratch, "rest").where(SIMILAR).select("a", "b")
    more = scratch.keep("links-2", more)
    scratch.drop("texts", "chosen", "hubs", "checked", "open", "known", "held", "place")
    if not more.isEmpty():
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
        roots = scratch.keep("roots-2", components(joined, scratch))
    scratch.drop("links-2")

    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = ids.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    component = rooted.join(least, "root").select("node", "root", "component")
    return rows.join(component, "node", "left").select(
        "doc_id", "tie", "n", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component")
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document row.

    ``n_shingles`` is the size of the row's set and ``component_id`` the smallest
    ``doc_id`` reachable by links. Words are runs without ASCII white space, A-Z
    in lower case; with fewer than five the whole sequence is one shingle. Texts
    that are null, empty or blank have no shingle and link with nothing: their
    component is their own id. Rows with a null id take part and get the least
    id they reach (null if there is none); rows that repeat an id are each in
    the component of their text. Other columns are ignored.
    """
    return _joined(documents).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, that of the least id; columns as they were.

    Rows without a shingle are in no group and stay. Of rows that repeat the
    least id with the same text, one stays.
    """
    scratch = Scratch(documents.sparkSession)
    joined = scratch.keep("joined", _joined(documents))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least")
    first = joined.where("node IS NOT NULL").groupBy("root").agg(least)
    kept = first.select("least.doc_id", "least.tie").union(joined.where("node IS NULL").select("doc_id", "tie").distinct())
    kept = kept.select(F.col("doc_id").alias("of_doc"), F.col("tie").alias("of_tie"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    same = documents["doc_id"].cast("long").eqNullSafe(F.col("of_doc")) & (tie == F.col("of_tie"))
    out = documents.join(kept, same, "left_semi")
    again = joined.where("node IS NOT NULL").groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1")
    if again.limit(1).count():  # else no row can repeat, and nothing has to be compared
        empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\u000b\u000c\r", " ")) == ""
        out = out.where(empty).unionByName(out.where(~empty).dropDuplicates(["doc_id", "text"]))
    return out

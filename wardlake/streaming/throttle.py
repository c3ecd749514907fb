"""Fixed windows anchored at the first event of a key, with a limit per window.

The first event of a key opens its window. Later events up to ``window`` after
that are in it, and the first ``limit`` pass; the next event after it opens a
new window. So an event's window depends on all events of its key before it, yet
no task has to see a whole key:

* Events are put in order of key and time and cut into pieces of at most
  ``2**PIECE_BITS`` events of one key. A piece is a *map* from the window that is
  open before it to the window open after it: either that window outlasts the
  piece, or the first event beyond it opens the next, and from there on all is
  known. A window open before the piece ends within a window after its first
  event, so the map has steps for the events up to there only.
* The maps of a key that has several pieces are chained in order; one map is
  held at a time, and nothing but maps passes there.
* With its opening window known, every piece is decided by itself.

Between micro-batches a key is one row: when its window opened and how many passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import delete_path, path_exists, scratch_path
from wardlake.streaming.ingest import run_available

PIECE_BITS = 16


def _decide(times: np.ndarray, window: int, limit: int, opened: int | None, passed: int):
    """Window start and verdict per time (sorted), and the state afterwards."""
    starts = np.empty(len(times), dtype=np.int64)
    allowed = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if opened is None or times[at] - opened > window:
            opened, passed = int(times[at]), 0
        end = int(np.searchsorted(times, opened + window, side="right"))
        free = min(max(limit, 1) - passed, end - at)
        starts[at:end] = opened
        allowed[at : at + max(free, 0)] = True
        passed += max(free, 0)
        at = end
    return starts, allowed, opened, passed


def window_map(
    times: np.ndarray, window: int, limit: int, latest: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of the map of sorted times, for windows opened up to ``latest`` (by default, up to the first time).

    A window that ends before ``until[i]`` (the first such) leads to one opened
    at ``opened[i]`` of whose events ``passed[i]`` passed.
    """
    n = len(times)
    following = np.searchsorted(times, times + window, side="right")
    last = np.where(following < n, following, np.arange(n))  # the window after the event's own, or its own
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reach = max(times[0], times[0] if latest is None else latest) + window
    asked = last[: int(np.searchsorted(times, reach, side="right")) + 1]  # up to the first event beyond it
    ends = np.flatnonzero(np.append(asked[1:] != asked[:-1], True))
    return times[ends], times[asked[ends]], np.minimum(n - asked[ends], max(limit, 1))


def after(state: tuple[int | None, int], until, opened, passed, n: int, window: int, limit: int) -> tuple[int, int]:
    """The window open after a piece of ``n`` events, by its map."""
    at = 0 if state[0] is None else int(np.searchsorted(until, state[0] + window, side="right"))
    if at == len(until):
        return state[0], min(state[1] + n, max(limit, 1))
    return int(opened[at]), int(passed[at])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), (column.offsets.to_numpy() - column.offsets[0].as_py())
    for low, high in zip(offsets, offsets[1:]):
        yield flat[low:high]


def _states(batch: pa.RecordBatch) -> list[tuple[int | None, int]]:
    return [(o, p or 0) for o, p in zip(batch["opened"].to_pylist(), batch["passed"].to_pylist())]


def _pieces(events: DataFrame) -> DataFrame:
    """``key, block, times, idents``: the events of a key in order, cut where a block of places ends."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "at", "ident"]
    placed = events.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("place", F.monotonically_increasing_id())  # grows over the ranges too
    rows = F.sort_array(F.collect_list(F.struct("place", "at", "ident")))
    blocks = placed.groupBy("key", F.shiftright("place", PIECE_BITS).alias("block")).agg(rows.alias("rows"))
    return blocks.select("key", "block", F.col("rows.at").alias("times"), F.col("rows.ident").alias("idents"))


def decide(
    events: DataFrame,
    key: str,
    ts: str,
    ident: str,
    window_seconds: int,
    limit: int,
    state: DataFrame | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts ``key, ident, opened, allowed`` of all events, and the state after them: ``key, opened, passed``.

    ``opened`` is the window's start in microseconds. Events at the same instant
    are taken in the order of ``ident``. A null key is a key; an event without a time is
    refused, as it is in no window. ``state`` is what an earlier call gave; an event that
    is older than its key's open window counts in that window. Both results read
    tables written below ``folder`` (by default one of their own in the shared folder).
    """
    window = window_seconds * 1_000_000
    spark = events.sparkSession
    folder = folder or scratch_path(spark, "throttle")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(ident).alias("ident"))
    kinds = dict(rows.dtypes)
    if state is None:
        state = spark.createDataFrame([], f"key {kinds['key']}, opened long, passed int")
    pieces = kept(_pieces(rows.where("at IS NOT NULL")), "pieces")
    carried = state.select(F.col("key").alias("of"), "opened", "passed")
    known = pieces.join(carried, F.col("key").eqNullSafe(F.col("of")), "left").drop("of")
    many = pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("of"))
    several = known.join(many, F.col("key").eqNullSafe(F.col("of")), "left_semi")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [window_map(t, window, limit, o) for t, (o, _) in zip(_lists(batch["times"]), _states(batch))]
            steps = [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(3)]
            n = pa.array([len(t) for t in _lists(batch["times"])], pa.int64())
            columns = [batch["key"], batch["block"], batch["opened"], batch["passed"], n, *steps]
            yield pa.RecordBatch.from_arrays(columns, ["key", "block", "opened", "passed", "n", "until", "to_opened", "to_passed"])

    mapped = several.select("key", "block", "opened", "passed", "times").mapInArrow(
        maps,
        f"key {kinds['key']}, block long, opened long, passed int, n long, until array<long>, to_opened array<long>, to_passed array<long>",
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = mapped.repartition(partitions, "key").sortWithinPartitions("key", "block")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, begun = None, (None, 0), False
        for batch in batches:
            out = []
            steps = zip(*(_lists(batch[c]) for c in ("until", "to_opened", "to_passed")), batch["n"].to_pylist())
            for k, first, step in zip(batch["key"].to_pylist(), _states(batch), steps):
                if not begun or k != at:
                    at, now, begun = k, first, True
                out.append(now)
                now = after(now, *step, window, limit)
            states = [pa.array([o for o, _ in out], pa.int64()), pa.array([p for _, p in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], *states], ["key", "block", "opened", "passed"])

    begins = chained.mapInArrow(chain, f"key {kinds['key']}, block long, opened long, passed int")
    begins = begins.select(
        F.col("key").alias("of"), F.col("block").alias("at_block"), F.struct("opened", "passed").alias("told")
    )
    told = known.join(begins, F.col("key").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at_block")), "left").select(
        "key", "block", "times", "idents",
        *(F.when(F.col("told").isNotNull(), F.col(f"told.{c}")).otherwise(F.col(c)).alias(c) for c in ("opened", "passed")),
    )

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_decide(t, window, limit, *s) for t, s in zip(_lists(batch["times"]), _states(batch))]
            columns = [
                batch["key"], batch["block"], batch["idents"],
                pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.bool_())),
                pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "block", "ident", "starts", "allowed", "opened", "passed"])

    schema = f"key {kinds['key']}, block long, ident array<{kinds['ident']}>, starts array<long>, allowed array<boolean>, opened long, passed int"
    done = kept(told.mapInArrow(verdicts, schema), "done")
    each = done.select("key", F.explode(F.arrays_zip("ident", "starts", "allowed")).alias("e"))
    timeless = rows.where("at IS NULL").select("key", "ident", F.lit(None).cast("long").alias("opened"), F.lit(False).alias("allowed"))
    decided = each.select("key", "e.ident", F.col("e.starts").alias("opened"), "e.allowed").unionByName(timeless)
    latest = done.groupBy("key").agg(F.max_by(F.struct("opened", "passed"), "block").alias("s")).select("key", "s.opened", "s.passed")
    idle = state.join(latest.select(F.col("key").alias("of")), F.col("key").eqNullSafe(F.col("of")), "left_anti")
    return decided, latest.unionByName(idle.select("key", "opened", "passed"))


def _snapshot(spark: SparkSession, folder: str, epoch: int, schema: str) -> DataFrame | None:
    """The state before ``epoch``."""
    path = f"{folder}/epoch={epoch - 1}"
    return spark.read.schema(schema).parquet(path) if epoch > 0 and path_exists(spark, path) else None


def throttle_available(
    stream: DataFrame, verdicts: str, checkpoint: str, key: str, ts: str, ident: str, window_seconds: int, limit: int
) -> None:
    """Decide all that has arrived; verdicts go to ``verdicts``/epoch=N.

    Batches must come in time order. The state of every micro-batch is a table
    of its own below ``checkpoint`` that holds the keys seen within two windows before the
    newest event; a batch that is replayed reads the same state and writes the same verdicts.
    """
    folder = f"{checkpoint}/windows"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = f"key {dict(batch.dtypes)[key]}, opened long, passed int"
        before, aside = _snapshot(spark, folder, epoch, schema), scratch_path(spark, "throttle")
        decided, state = decide(batch, key, ts, ident, window_seconds, limit, before, aside)
        decided.write.mode("overwrite").parquet(f"{verdicts}/epoch={epoch}")
        newest = state.agg(F.max("opened")).first()[0]
        live = state if newest is None else state.where(F.col("opened") >= newest - 2 * window_seconds * 1_000_000)
        live.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        delete_path(spark, aside)
        if epoch > 1:
            delete_path(spark, f"{folder}/epoch={epoch - 2}")

    run_available(stream, f"{checkpoint}/stream", each)

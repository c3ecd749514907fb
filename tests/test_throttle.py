"""The throttle: window maps, pieces of hot keys, batches and replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_governance import brute_throttle

from wardlake.session import delete_path
from wardlake.streaming import throttle
from wardlake.streaming.ingest import arriving


def test_maps_chain_like_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(300):
        times = np.sort(rng.integers(0, 200, rng.integers(2, 60)))
        window, limit = int(rng.integers(0, 50)), int(rng.integers(1, 6))
        state, got = (None, 0), []
        for piece in (p for p in np.array_split(times, int(rng.integers(1, 8))) if len(p)):
            starts, allowed, *direct = throttle._decide(piece, window, limit, *state)
            got += list(zip(starts.tolist(), allowed.tolist()))
            until, opened, passed = throttle.window_map(piece, window, limit)
            assert (until[:-1] <= piece[0] + window).all()  # no steps that no window can ask for
            state = throttle.after(state, until, opened, passed, len(piece), window, limit)
            assert list(state) == direct
        assert got == brute_throttle(times.tolist(), window, limit)


EVENTS = "user string, at long, id long, ts timestamp, place int, block int"


def events(spark, rows):
    frame = spark.createDataFrame([(u, a, i, None, 0, 0) for u, a, i in rows], EVENTS)
    return frame.withColumn("ts", F.timestamp_micros("at"))


def expected(rows, window, limit):
    out = {}
    for user in {u for u, _, _ in rows}:
        mine = sorted((a, i) for u, a, i in rows if u == user and a is not None)
        for (_, i), verdict in zip(mine, brute_throttle([a for a, _ in mine], window * 1_000_000, limit)):
            out[user, i] = verdict
        out |= {(u, i): (None, False) for u, a, i in rows if u == user and a is None}
    return out


def given(decided):
    return {(r.key, r.ident): (r.opened, r.allowed) for r in decided.collect()}


def a_hot_user(n=600):
    rng = np.random.default_rng(7)
    rows = [("hot", int(a), i) for i, a in enumerate(rng.integers(0, 300_000_000, n // 3))]
    users = ["a", "b", "c", None, ""]
    rows += [(users[i % 5], int(rng.integers(0, 300_000_000)), n + i) for i in range(n - n // 3)]
    return rows + [("a", None, 5000), ("b", rows[0][1], 5001), ("b", rows[0][1], 5002)]


@pytest.mark.parametrize("bits", [3, 16])
def test_pieces_of_a_hot_user_decide_as_one(spark, monkeypatch, bits):
    monkeypatch.setattr(throttle, "PIECE_BITS", bits)
    rows = a_hot_user()
    decided, state = throttle.decide(events(spark, rows), "user", "ts", "id", 9, 3)
    assert given(decided) == expected(rows, 9, 3)
    ends = {u: max((o, i) for (v, i), (o, _) in expected(rows, 9, 3).items() if v == u and o is not None)[0] for u in ("hot", "a", None)}
    assert {r.key: r.opened for r in state.collect() if r.key in ends} == ends
    # No row holds more of a key than a piece.
    assert throttle._pieces(events(spark, rows).select(F.col("user").alias("key"), "at", F.col("id").alias("ident")).where("at IS NOT NULL")).agg(
        F.max(F.size("times"))
    ).first()[0] <= 1 << bits


def test_state_carries_over_and_late_events_join_the_open_window(spark):
    first, state = throttle.decide(events(spark, [("a", 10_000_000, 1), ("b", 10_000_000, 2)]), "user", "ts", "id", 9, 2)
    later = [("a", 12_000_000, 3), ("a", 13_000_000, 4), ("a", 9_000_000, 5), ("c", 1, 6)]
    second, state = throttle.decide(events(spark, later), "user", "ts", "id", 9, 2, state)
    assert given(first) == {("a", 1): (10_000_000, True), ("b", 2): (10_000_000, True)}
    assert given(second) == {("a", 5): (10_000_000, True), ("a", 3): (10_000_000, False), ("a", 4): (10_000_000, False), ("c", 6): (1, True)}
    assert {(r.key, r.opened, r.passed) for r in state.collect()} == {("a", 10_000_000, 2), ("b", 10_000_000, 1), ("c", 1, 1)}
    nothing, same = throttle.decide(events(spark, []), "user", "ts", "id", 9, 2, state)
    assert nothing.collect() == [] and same.count() == 3


def test_stream_in_stretches_and_a_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(throttle, "PIECE_BITS", 4)
    rows = sorted((r for r in a_hot_user() if r[1] is not None), key=lambda r: r[1])
    arrivals, verdicts, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def work():
        throttle.throttle_available(arriving(spark, arrivals, events(spark, []).schema), verdicts, checkpoint, "user", "ts", "id", 9, 3)
        return given(spark.read.schema("key string, ident long, opened long, allowed boolean, epoch int").parquet(verdicts))

    for part in range(4):
        here = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
        events(spark, here).write.mode("append").parquet(arrivals)
        got = work()
    assert got == expected(rows, 9, 3)
    live = spark.read.parquet(f"{checkpoint}/windows/epoch=3").agg(F.min("opened")).first()[0]
    assert live >= max(a for _, a, _ in rows) - 3 * 9_000_000  # closed windows are not kept
    # A batch that failed before its commit runs again from the state before it.
    delete_path(spark, f"{checkpoint}/stream/commits/3")
    delete_path(spark, f"{verdicts}/epoch=3")
    assert work() == got

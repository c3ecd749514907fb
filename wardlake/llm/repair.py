"""Conversation structure repair: the cheapest edits that make turns alternate, by divide and conquer.

A legal conversation has an optional system turn, then user and assistant turns
in pairs. Reading roles one by one passes four states (nothing yet, after
system, after user, after assistant), and each edit of a row (keep, rerole,
delete, or inserts before it) is a step between them. Hirschberg's scheme finds
the best edits in linear space: cost vectors over the four states run forward
to a middle row and backward to it, the best crossing is chosen there, and both
halves are solved alone.

Ties go to the ASCII-least string of edit initials. Strings that lead from one
row boundary to another and end by using up a row are prefix-free (equally many
of their letters use up a row), so they compare the same whatever follows, and
the forward vector only has to carry the *order* of its four strings.

The division starts in Spark. A conversation is cut into pieces of at most
``PIECE`` rows; a piece is summed up as a 4x4 table of costs and orders, tables
of up to ``FAN`` neighbours become one, and so on up to one per conversation.
On the way down each table is told its state at both ends and tells its parts.
So no task holds a whole conversation, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.scratch import Scratch, partitions

PIECE_BITS, FAN_BITS = 12, 10
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: The least way to end in each state: the inserts after the last row.
TAIL, TAIL_COST = ["", "II", "I", ""], [0, 6, 3, 0]
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
INK = r"[^\x20\x09-\x0D]"
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


@cache
def steps(symbol: int) -> list[list[tuple[int, str] | None]]:
    """``[from][to]``: cost and least letters of taking one row; ``symbol`` is 4 x initial + fault."""
    initial, fault = divmod(symbol, 4)
    extra = 3 if FAULTS[fault] == "truncated" else 0
    table: list[list] = [[None] * 4 for _ in range(4)]
    for begin in range(4):
        state = begin
        for inserts in range(3):  # more would come back to a state
            ways = [("D", state, 4)]
            if FAULTS[fault] not in ("blank", "duplicate"):
                ways.append(("R", _inserted(state), 3 + extra))
                if (initial == 0 and state == START) or (initial in (1, 2) and initial + 1 == _inserted(state)):
                    ways.append(("K", initial + 1, extra))
            for letter, end, cost in ways:
                way = (cost + 3 * inserts, "I" * inserts + letter)
                table[begin][end] = min(table[begin][end] or way, way)
            state = _inserted(state)
    return table


def forward(symbols, begin: int) -> tuple[list[int], list[int]]:
    """Costs of reaching each state from ``begin``, and the order of the four least strings."""
    cost, order = [INF] * 4, [0] * 4
    cost[begin] = 0
    for symbol in symbols:
        table, best = steps(symbol), []
        for end in range(4):
            ways = [
                (cost[p] + way[0], order[p], way[1]) for p in range(4) if cost[p] < INF and (way := table[p][end]) is not None
            ]
            best.append(min(ways, default=(INF, 9, "")))
        cost = [w[0] for w in best]
        rank = {w: i for i, w in enumerate(sorted({w[1:] for w in best}))}
        order = [rank[w[1:]] for w in best]
    return cost, order


def backward(symbols, after: list[int]) -> list[int]:
    """What is still to pay from each state before ``symbols``, given what it is after them."""
    for symbol in reversed(symbols):
        table = steps(symbol)
        after = [min((way[0] + after[q] for q in range(4) if (way := table[p][q])), default=INF) for p in range(4)]
    return after


def edits(symbols: bytes, begin: int, after: list[int]) -> list[str]:
    """The letters of each row (inserts before it, then its own edit), in linear space."""
    out: list[str] = []

    def solve(low: int, high: int, begin: int, after: list[int]) -> int:
        if high - low == 1:
            table = steps(symbols[low])[begin]
            _, letters, end = min((way[0] + after[q], way[1], q) for q in range(4) if (way := table[q]))
            out.append(letters)
            return end
        middle = (low + high) // 2
        cost, order = forward(symbols[low:middle], begin)
        left = backward(symbols[middle:high], after)
        cross = min(range(4), key=lambda c: (cost[c] + left[c], order[c]))
        solve(low, middle, begin, [0 if c == cross else INF for c in range(4)])
        return solve(middle, high, cross, after)

    if symbols:
        solve(0, len(symbols), begin, after)
    return out


def summary(symbols: bytes) -> list[int]:
    """Costs and orders from each of the four states: 32 numbers."""
    return [n for begin in range(4) for part in forward(symbols, begin) for n in part]


def _row(table, begin: int) -> tuple[list[int], list[int]]:
    return table[8 * begin : 8 * begin + 4], table[8 * begin + 4 : 8 * begin + 8]


def _then(cost, order, table) -> tuple[list[int], list[int]]:
    """A forward vector after one more table."""
    rows, best = [_row(table, p) for p in range(4)], []
    for end in range(4):
        ways = [(cost[p] + rows[p][0][end], order[p], rows[p][1][end]) for p in range(4) if cost[p] < INF and rows[p][0][end] < INF]
        best.append(min(ways, default=(INF, 9, 9)))
    rank = {w: i for i, w in enumerate(sorted({w[1:] for w in best}))}
    return [w[0] for w in best], [rank[w[1:]] for w in best]


def joined(tables) -> list[int]:
    """One table for neighbouring ones."""
    out = []
    for begin in range(4):
        cost, order = [0 if p == begin else INF for p in range(4)], [0] * 4
        for table in tables:
            cost, order = _then(cost, order, table)
        out += cost + order
    return out


def crossings(tables, begin: int, end: int | None) -> list[int]:
    """The state at the end of each of ``tables`` on the best way; ``end`` None is the end of the conversation."""
    backs = [TAIL_COST if end is None else [0 if c == end else INF for c in range(4)]]
    for table in reversed(tables):
        rows = [_row(table, p)[0] for p in range(4)]
        backs.append([min(INF, *(rows[p][q] + backs[-1][q] for q in range(4))) for p in range(4)])
    backs.reverse()
    cost, order, out = [0 if p == begin else INF for p in range(4)], [0] * 4, []
    for table, after in zip(tables, backs[1:], strict=True):
        cost, order = _then(cost, order, table)
        out.append(min(range(4), key=lambda c: (cost[c] + after[c], order[c])))
    return out


# The same over Arrow batches. Numbers of tables over INF stay INF by min.


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` maps one row (a dict) to a list of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                out = [made for row in batch.slice(low, 512).to_pylist() for made in function(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in schema.split(", "))])
    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
}


def marked(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, place, initial, fault``, a written table in order of conversation and turn.

    Rows of one turn are ordered by role, the first 64 characters of the text, then its
    SHA-256. ``place`` grows in this order, over all tasks.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    # Short keys, of which Spark samples some to find the ranges; equal rows are told apart by where they were read.
    keys = [
        F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64),
        F.sha2(F.col("text").cast("binary"), 256), F.monotonically_increasing_id(),
    ]
    keyed = rows.select("*", *(k.alias(f"key_{i}") for i, k in enumerate(keys)))
    names = [f"key_{i}" for i in range(len(keys))]
    dealt = keyed.repartitionByRange(partitions(conversations.sparkSession), *names).sortWithinPartitions(*names)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    last = F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(INK), 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return scratch.keep(
        "turns",
        dealt.select(
            "conv_id", "turn", "role", "text",
            F.monotonically_increasing_id().alias("place"),
            initial.cast("int").alias("initial"),
            fault.cast("int").alias("fault"),
            F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text").cast("binary"), 256)).alias("said"),
        ),
    )


def pieces(turns: DataFrame) -> DataFrame:
    """``conv_id, block, places, symbols``: at most 2**PIECE_BITS neighbouring rows of a conversation each.

    A row repeats an earlier one if its place is not the first of its role and
    text (told by 256 bits); first places are found by sums before the shuffle
    and met by place, so a turn repeated any number of times is no hot key.
    """
    first = turns.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    known = turns.select("conv_id", "place", "initial", "fault").join(first, "place", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    row = F.struct("place", (F.col("initial") * 4 + fault).cast("int").alias("symbol"))
    blocks = known.groupBy("conv_id", F.shiftright("place", PIECE_BITS).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return blocks.select("conv_id", "block", F.col("rows.place").alias("places"), F.col("rows.symbol").alias("symbols"))


def _ends(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, block, begin, end`` of the pieces of conversations that have several; ``end`` is null for the last."""
    many = known.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"))
    some = known.join(many, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    summed = _mapped(
        some.select("conv_id", "block", "symbols"),
        lambda r: [{"conv_id": r["conv_id"], "block": r["block"], "numbers": summary(r["symbols"])}],
        "conv_id long, block long, numbers array<long>",
    )
    levels = [scratch.keep("tables-0", summed)]
    parts = F.sort_array(F.collect_list(F.struct("block", "numbers")))

    def grouped(level: DataFrame) -> DataFrame:
        return level.groupBy("conv_id", F.shiftright("block", FAN_BITS).alias("parent")).agg(parts.alias("parts"))

    while not levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        up = _mapped(
            grouped(levels[-1]),
            lambda r: [{"conv_id": r["conv_id"], "block": r["parent"], "numbers": joined([p["numbers"] for p in r["parts"]])}],
            "conv_id long, block long, numbers array<long>",
        )
        levels.append(scratch.keep(f"tables-{len(levels)}", up))
    known_ends = levels[-1].select("conv_id", "block", F.lit(START).alias("begin"), F.lit(None).cast("int").alias("end"))

    def down(r: dict) -> list[dict]:
        ends = crossings([p["numbers"] for p in r["parts"]], r["begin"], r["end"])
        begins = [r["begin"], *ends[:-1]]
        if r["end"] is None:
            ends[-1] = None
        return [
            {"conv_id": r["conv_id"], "block": p["block"], "begin": b, "end": e}
            for p, b, e in zip(r["parts"], begins, ends, strict=True)
        ]

    for level in reversed(levels[:-1]):
        told = known_ends.select(F.col("conv_id").alias("of"), F.col("block").alias("parent"), "begin", "end")
        both = grouped(level).withColumnRenamed("parent", "at").join(
            told, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("parent"))
        )
        known_ends = _mapped(both.select("conv_id", "parts", "begin", "end"), down, "conv_id long, block long, begin int, end int")
    return scratch.keep("ends", known_ends)


def _solved(r: dict) -> list[dict]:
    symbols, begin, end = r["symbols"], r["begin"] or START, r["end"]
    inner = r["several"] and end is not None
    letters = edits(symbols, begin, [0 if c == end else INF for c in range(4)] if inner else TAIL_COST)
    state, roles, cost = begin, [], 0
    for symbol, each in zip(symbols, letters, strict=True):
        new = ""
        for letter in each:
            if letter == "K":
                state = symbol // 4 + 1
            elif letter in "IR":
                state = _inserted(state)
            new += INITIALS[state - 1] if letter in "IRK" else ""
        roles.append(new)
        cost += 3 * each.count("I") + {"D": 4, "R": 3, "K": 0}[each[-1]] + (3 if symbol % 4 == 3 and each[-1] != "D" else 0)
    tail = "" if inner else TAIL[state]
    initials = [s // 4 for s in symbols]
    legal = {(0, 1), (1, 2), (2, 1)}
    return [
        {
            "conv_id": r["conv_id"], "block": r["block"], "places": r["places"], "letters": letters, "roles": roles,
            "tail": tail, "tail_begin": state, "cost": cost + 3 * len(tail),
            "faults": [sum(s % 4 == f for s in symbols) for f in (1, 2, 3)],
            "illegal": sum(pair not in legal for pair in zip(initials, initials[1:], strict=False)),
            "first_initial": initials[0], "last_initial": initials[-1],
        }
    ]


class Repair:
    """The repair of a table of conversations (``conv_id, turn, role, text``; other columns are ignored).

    Null roles and texts are one space, a null ``conv_id`` is a conversation of
    its own, null turns come first, repeated rows are repeated turns. Texts are
    never cut; an empty table gives empty results. Intermediate tables are
    written below the shared folder.
    """

    def __init__(self, conversations: DataFrame):
        scratch = Scratch(conversations.sparkSession)
        self.turns = marked(conversations, scratch)
        known = scratch.keep("pieces", pieces(self.turns))
        ends = _ends(known, scratch).select(F.col("conv_id").alias("of"), F.col("block").alias("at"), "begin", "end", F.lit(True).alias("told"))
        told = known.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")), "left")
        schema = (
            "conv_id long, block long, places array<long>, letters array<string>, roles array<string>, tail string, "
            "tail_begin int, cost long, faults array<long>, illegal long, first_initial int, last_initial int"
        )
        several = F.col("told").isNotNull().alias("several")
        self.solved = scratch.keep("solved", _mapped(told.select("conv_id", "block", "places", "symbols", "begin", "end", several), _solved, schema))

    def conversations(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows.

        ``audit`` has the edit initials in order: I insert, K keep, R rerole, D
        delete. Inserts after the last row belong to the last piece.
        """
        part = F.struct(
            "block", "first_initial", "last_initial", F.concat(F.array_join("letters", ""), F.col("tail")).alias("audit")
        )
        sums = self.solved.groupBy("conv_id").agg(
            *(F.sum(F.col("faults")[i]).alias(name) for i, name in enumerate(FAULTS[1:])),
            F.sum("cost").alias("cost"),
            F.sum("illegal").alias("inside"),
            F.sort_array(F.collect_list(part)).alias("parts"),  # one per piece, not per row
        )
        pairs = F.arrays_zip(
            F.slice(F.col("parts.last_initial"), F.lit(1), F.size("parts") - 1).alias("a"),
            F.slice(F.col("parts.first_initial"), F.lit(2), F.size("parts") - 1).alias("b"),
        )
        broken = F.size(F.filter(pairs, lambda p: ~(p["a"] * 4 + p["b"]).isin(1, 6, 9)))
        spans = self.turns.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        )
        spans = spans.select(F.col("conv_id").alias("of"), "gaps")
        return sums.join(spans, F.col("conv_id").eqNullSafe(F.col("of"))).select(
            "conv_id", "gaps", *FAULTS[1:], (F.col("inside") + broken).alias("illegal"), "cost",
            F.array_join(F.col("parts.audit"), "").alias("audit"),
        )

    def rows(self) -> DataFrame:
        """``conv_id, place, step, edit, role, text``: the repaired turns, to be ordered by place and step.

        Inserted turns have no text. Deleted turns are not there. Each row's edits
        meet its text by its place, which no two rows share.
        """
        exploded = self.solved.select(F.explode(F.arrays_zip("places", "letters", "roles")).alias("e")).select("e.*")
        kept = exploded.where("roles <> ''").select("places", "letters", "roles")
        row = self.turns.select("conv_id", "place", "role", "text").join(kept, F.col("place") == F.col("places"))
        new = F.transform(F.split("roles", ""), _role_name)
        letter = F.split("letters", "")
        steps = row.select(
            "conv_id", "place", F.col("role").alias("old"), "text",
            F.posexplode(F.arrays_zip(new.alias("role"), F.slice(letter, F.lit(1), F.size(new)).alias("edit"))).alias("step", "e"),
        )
        inserted = F.col("e.edit") == "I"
        turns = steps.select(
            "conv_id", "place", "step", F.col("e.edit").alias("edit"),
            F.when(F.col("e.edit") == "K", F.col("old")).otherwise(F.col("e.role")).alias("role"),
            F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        )
        added = F.when(F.length("tail") == 2, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("assistant")))
        tails = self.solved.where("tail <> ''").select(
            "conv_id", F.element_at("places", -1).alias("place"), F.posexplode(added).alias("step", "role")
        )
        return turns.unionByName(
            tails.select(
                "conv_id", "place", (F.col("step") + 99).alias("step"), F.lit("I").alias("edit"), "role", F.lit("").alias("text")
            )
        )


def _role_name(initial: Column) -> Column:
    return F.when(initial == "u", "user").when(initial == "a", "assistant").otherwise("system")


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's ``role:text`` lines, in order, newline between.

    A digest reads its bytes one after the other, so a conversation's rows pass
    through one task here, as a stream that is never held.
    """
    line = F.concat("role", F.lit(":"), "text").cast("binary")
    ordered = rows.select("conv_id", "place", "step", line.alias("line"))
    ordered = ordered.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            ids, shas = [], []
            for conv, said in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if state is None or conv != at:
                    if state is not None:
                        ids.append(at)
                        shas.append(state.hexdigest())
                    at, state = conv, sha256()
                else:
                    state.update(b"\n")
                state.update(said.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return ordered.select("conv_id", "line").mapInArrow(run, "conv_id long, sha256 string")

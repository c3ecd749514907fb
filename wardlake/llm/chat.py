"""Chat formatting: one training text per conversation, with Spark expressions only.

Turns are collected and sorted as structs, neighbouring turns of one role become
one block, and the text is the concatenation of segments. The loss mask is the
list of segments itself: each has its characters of the text and a flag.

Template: ``### role:\\n`` text ``<and/>`` text ... ``</turn>\\n`` per block.
``\\``, ``#``, ``<`` (and ``:`` in roles) never appear in escaped text, so no text
can look like a mark, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, ROLE_END, JOINT, END = "### ", ":\n", "<and/>", "</turn>\n"
#: Escape codes; the backslash comes first when escaping and last when reading.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        text = _replace(text, plain, code)
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = _replace(text, code, plain)
    return text


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, segments``: one row per conversation.

    ``segments`` is ``array<struct<text, loss>>``; its texts joined are
    ``formatted``, and ``loss`` marks the (escaped) texts of ``trained_role``.

    A null text or role is the empty string, a null turn number comes first, a
    null ``conv_id`` is a conversation of its own. Rows with one turn number are
    ordered by role, then text; repeated rows are repeated turns. Other columns
    are ignored. An empty table gives no rows. The work per conversation is
    linear in its size; the text itself must fit one cell.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    rest = F.size("turns") - 1
    none = F.array(F.lit(None).cast("string"))
    beside = grouped.select(
        "conv_id",
        F.arrays_zip(
            F.col("turns").alias("turn"),
            F.concat(none, F.slice(roles, F.lit(1), rest)).alias("before"),
            F.concat(F.slice(roles, F.lit(2), rest), none).alias("after"),
        ).alias("turns"),
    )

    def segments(t: Column) -> Column:
        role, text = t["turn"]["role"], t["turn"]["text"]
        opened = F.concat(F.lit(HEAD), escape(role, role=True), F.lit(ROLE_END))
        before = F.when(t["before"] == role, F.lit(JOINT)).otherwise(opened)
        after = F.when(t["after"] == role, F.lit("")).otherwise(F.lit(END))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(text).alias("text"), (role == trained_role).alias("loss")),
            F.struct(after.alias("text"), F.lit(False).alias("loss")),
        )

    cut = beside.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: ``array<struct<role, text>>``, in order."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ROLE_END, 1)
        body = F.substr(block, F.length(role) + len(ROLE_END) + 1)
        role = unescape(F.substr(role, F.lit(len(HEAD) + 1)))
        return F.transform(
            F.split(body, JOINT), lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))
        )

    blocks = F.filter(F.split(formatted, END), lambda block: block != "")
    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))

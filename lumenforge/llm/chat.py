"""Operator 6 [native]: chat formatting with DataFrame functions only.

A declarative template gives each role its opening and closing control strings and its loss flag, and a finite-state machine
over roles (states and allowed next roles) validates the turn order. Turns become text segments with loss flags; control
strings inside texts are escaped reversibly, so the formatted text can be read back turn by turn.

Escape rule: a backslash is doubled, and each of < > [ ] is followed by one backslash, so no control string of the template
can occur inside an escaped text; undoing it is one left-to-right pass.

Defined results: rows without a conversation id are one conversation of their own (null id); turns are ordered by (turn, role,
text), nulls first, so ties and repeated rows have one order; a null text is an empty text; a null role is the empty role;
roles outside the template are formatted alike without loss, and their order is invalid; an invalid order is formatted too and
flagged in `valid`; an empty table gives an empty table. Columns other than the four named ones are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "begin": "<s>",
    "end": "</s>",
    "roles": {"system": {"loss": False}, "user": {"loss": False}, "assistant": {"loss": True}},
    "open": ("<turn:", ">\n"),
    "close": "</turn>",
}
#: state -> {role: next state}; a conversation is valid if it ends in one of ENDS.
MACHINE = {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
ENDS = ("asked", "answered")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<>\[\]])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<>\[\]])\\|\\(\\)", "$1$2")


def state_after(roles: Column, machine: dict = MACHINE) -> Column:
    """Last state of the machine over an array of roles; 'bad' once a role isn't allowed."""

    def step(state: Column, role: Column) -> Column:
        moves = [((state == s) & (role == r), to) for s, row in machine.items() for r, to in row.items()]
        return reduce(lambda rest, m: F.when(m[0], F.lit(m[1])).otherwise(rest), reversed(moves), F.lit("bad"))

    return F.aggregate(roles, F.lit("start"), step)


def format_chat(df: DataFrame, template: dict = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, segments array<struct<text, loss>>, formatted, n_turns, valid."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = df.select(F.col(conv_col).alias("_conv"), turn.alias("_turn")).groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    learned = [r for r, x in template["roles"].items() if x["loss"]]

    def segments(t: Column) -> Column:
        opening = F.concat(F.lit(template["open"][0]), escaped(t["role"]), F.lit(template["open"][1]))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), t["role"].isin(learned).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    def edge(text: str) -> Column:
        return F.array(F.struct(F.lit(text).alias("text"), F.lit(False).alias("loss")))

    parts = F.concat(edge(template["begin"]), F.flatten(F.transform("_turns", segments)), edge(template["end"]))
    made = turns.select("_conv", F.size("_turns").cast("long").alias("n_turns"), F.transform("_turns", lambda t: t["role"]).alias("_roles"), parts.alias("segments"))
    return made.select(
        F.col("_conv").alias(conv_col), "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        "n_turns", state_after(F.col("_roles")).isin(*ENDS).alias("valid"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    inner = F.substring(formatted, F.lit(len(template["begin"]) + 1), F.char_length(formatted) - len(template["begin"]) - len(template["end"]))
    pieces = F.split(inner, template["close"])
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = len(template["open"][0]) + len(template["open"][1])
    opening, closing = (re.escape(x) for x in template["open"])

    def turn(p: Column) -> Column:
        # a > of the role has a backslash behind it, that of the template its line break
        role = F.regexp_extract(p, "^" + opening + r"((?:[^>]|>\\)*)" + closing, 1)
        text = F.substring(p, F.char_length(role) + start + 1, F.char_length(p))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])))


def digests(df: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and its loss mask."""
    made = format_chat(df).select("conv_id", "segments", "formatted", "valid", read_turns(F.col("formatted")).alias("_turns"), loss_text(F.col("segments")).alias("_loss"))
    told = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return made.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )

"""Chat formatting.

A template says how turns are marked, which strings are control strings, which roles are learnt from and which role may
follow which. Formatting a conversation emits segments, each a text with a flag that says whether loss is
taken on it; the formatted text is their concatenation. A finite-state machine over the roles finds the first turn
that is out of order.

Control strings inside a text or role are escaped: a backslash is put behind their first character, and backslashes of the text
are doubled, so an odd backslash is always an inserted one. Formatting can thus be read back.

A conversation is one row, as its formatted text is.

Defined results: a null text or role is an empty one; turns stand in the order of their numbers, a null number first,
equal ones by role and text; rows that repeat are turns of their own; turns without a conversation form one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``before`` and ``after`` the role, and ``end`` of a turn; ``learnt`` roles; ``follows``: state and role to the
    next state, from ``start`` on; a role that isn't listed for a state is out of order."""

    before: str = '<turn role="'
    after: str = '">\n'
    end: str = "</turn>\n"
    controls: tuple[str, ...] = ("<turn", "</turn", '">')
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    follows: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )

    def __post_init__(self) -> None:
        for s in self.controls:
            if len(s) < 2 or "\\" in s:
                raise ValueError(f"control string {s!r}: two characters at least, and no backslash")
        for mark in (self.before, self.after, self.end):
            if not any(s in mark for s in self.controls):
                raise ValueError(f"mark {mark!r} holds no control string, so a text could hold the mark")


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in template.controls:
        text = F.replace(text, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """Of two backslashes one stays, of a single one none."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv_id, segments, formatted, valid, first_wrong)``: ``segments`` are ``(text, loss)``, ``first_wrong`` is the
    place of the first turn out of order, from 0, the number of turns if only the end is missing, else null."""
    template = template or Template()
    said = F.struct(F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col(conv).alias("conv_id"), said.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.before), escape(t["role"], template), F.lit(template.after))
        return F.array(
            part(head, F.lit(False)), part(escape(t["text"], template), t["role"].isin(*template.learnt)), part(F.lit(template.end), F.lit(False))
        )

    moves = F.map_from_arrays(
        F.array(*[F.lit(f"{state}\n{role}") for state, role in template.follows]), F.array(*[F.lit(s) for s in template.follows.values()])
    )
    # a state, or the place of the first wrong turn once there is one
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("wrong"))

    def step(at: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws("\n", at["state"], t["role"]))
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"), (at["i"] + 1).alias("i"),
            F.coalesce(at["wrong"], F.when(to.isNull(), at["i"])).alias("wrong"),
        )

    run = F.aggregate("turns", begin, step)
    rows = rows.withColumns({"segments": F.flatten(F.transform("turns", segments)), "_run": run})
    ended = F.when(~F.col("_run.state").isin(*template.final), F.col("_run.i"))
    return rows.select(
        "conv_id", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.coalesce("_run.wrong", ended).alias("first_wrong"),
    ).withColumn("valid", F.col("first_wrong").isNull())


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, turns, learnt, formatted, valid)``: turns ``(role, text)`` from the formatted text alone, and the texts under
    the loss mask from the segments."""
    template = template or Template()
    parts = F.split("formatted", re.escape(template.end))
    # every turn ends with the mark, so the last part is empty
    cut = F.slice(parts, F.lit(1), F.size(parts) - 1)
    begin = len(template.before) + 1

    def turn(x: Column) -> Column:
        at = F.locate(template.after, x)
        role = x.substr(F.lit(begin), at - begin)
        text = x.substr(at + len(template.after), F.length(x))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", F.transform(cut, turn).alias("turns"), learnt.alias("learnt"), "formatted", "valid")

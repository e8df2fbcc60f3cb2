"""Elements of a document, found inside its row: one fold over its tags with an explicit stack.

A first fold, from the last tag to the first, tells which start tags have an end tag; a second one, forwards, keeps the
elements that are open. Nothing is exploded, sorted or moved. Values that are written are gathered in piles of ``PILE``, since
appending to an array copies it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.bind import let, then

#: What a tag does.
NONE, VOID, START_INLINE, END_INLINE, START, END = range(6)
#: What an open element is: a pair of tags, one whose end tag is left out, an inline one, any other without an end tag.
PAIRED, LOOSE, INLINE, OPEN = range(4)

PILE = 128

HEAD = "struct<pos:int,tag:string,role:int,rank:int,optional:boolean,raw:string>"
_SPAN = "struct<start_pos:int,end_pos:int,parent_pos:int,depth:int>"
_OPENED = "struct<pos:int,kind:int,rank:int,key:string,base:int,parent:int,depth:int>"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def pile(kind: str) -> Column:
    """The field ``pile`` of a fold's state, empty."""
    return F.struct(empty(kind).alias("cur"), empty(f"array<{kind}>").alias("done")).alias("pile")


def piled(state: Column, values: Column) -> Column:
    """The field ``pile`` of a fold's state with ``values``, which should be bound, added."""
    held = state["pile"]
    full = F.struct(values.alias("cur"), F.concat(held["done"], F.array(held["cur"])).alias("done"))
    more = F.struct(F.concat(held["cur"], values).alias("cur"), held["done"].alias("done"))
    return F.when(F.size(values) == 0, held).when(F.size(held["cur"]) + F.size(values) > PILE, full).otherwise(more).alias("pile")


def unpiled(state: Column) -> Column:
    return F.concat(F.flatten(state["pile"]["done"]), state["pile"]["cur"])


def _rank(tag: Column) -> Column:
    by_rank = {r: [t for t, x in K.OPTIONAL_END_RANK.items() if x == r] for r in (1, 2, 3)}
    return F.when(tag.isin(by_rank[1]), 1).when(tag.isin(by_rank[2]), 2).when(tag.isin(by_rank[3] + K.BLOCK_TAGS), 3)


def heads(raws: Column, name_of, kind_of) -> Column:
    """What is needed of every tag, from an array of tags as they are written."""

    def head(raw: Column, i: Column) -> Column:
        def of(name: Column) -> Column:
            inline = name.isin(K.INLINE_TAGS)
            role = F.when(kind_of(raw, name) == "decl", NONE).when(kind_of(raw, name) == "void", VOID)
            role = role.when(raw.startswith("</"), F.when(inline, END_INLINE).otherwise(END)).otherwise(F.when(inline, START_INLINE).otherwise(START))
            fields = [i.alias("pos"), name.alias("tag"), role.alias("role"), _rank(name).alias("rank"), name.isin(list(K.OPTIONAL_END_RANK)).alias("optional"), raw.alias("raw")]
            return F.struct(*fields).cast(HEAD)

        return let(name_of(raw), of)

    return F.transform(raws, head)


def _paired_starts(tags: Column) -> Column:
    """Positions of start tags that have an end tag, last one first.

    Tags pair like brackets of one name; a paragraph only if no paragraph or block starts before its end.
    """
    start = F.struct(empty("string").alias("ends"), F.lit(False).alias("closing"), pile("int"))

    def merge(s: Column, h: Column) -> Column:
        starts, ends, p = h["role"] == START, h["role"] == END, h["tag"] == "p"
        at = F.when(starts & ~p, F.array_position(s["ends"], h["tag"])).otherwise(F.lit(0).cast("bigint"))

        def with_place(s: Column, at: Column) -> Column:
            rest = F.concat(F.slice(s["ends"], F.lit(1), (at - 1).cast("int")), F.slice(s["ends"], (at + 1).cast("int"), F.size(s["ends"])))
            left = F.when(ends & ~p, F.array_append(s["ends"], h["tag"])).when(at > 0, rest).otherwise(s["ends"])
            paired = (at > 0) | (starts & p & s["closing"])
            closing = F.when((starts | ends) & p, ends).when(starts & h["rank"].eqNullSafe(F.lit(3)), False).otherwise(s["closing"])
            found = F.when(paired, F.array(h["pos"])).otherwise(empty("int"))
            return then(s, found, lambda s, found: F.struct(left.alias("ends"), closing.alias("closing"), piled(s, found)))

        return then(s, at, with_place)

    return F.aggregate(F.reverse(tags), start, merge, unpiled)


def spans(tags: Column, size: Column) -> Column:
    """Intervals of all elements in the order of their start tags: ``array<struct<start_pos, end_pos, parent_pos, depth>>``.

    ``tags`` are ``heads``, ``size`` is the number of tokens. The rules for markup that is not well-formed are those
    at the head of ``html.py``.
    """
    start = F.struct(
        empty(_OPENED).alias("open"), empty("string").alias("keys"), F.lit(0).alias("base"), F.lit(0).alias("used"),
        pile(_SPAN),
    )

    def place(values: Column) -> Column:
        """Of the first true value, null if there is none."""
        return F.nullif(F.array_position(values, F.lit(True)), F.lit(0)).cast("int")

    def merge(s: Column, h: Column, paired_at: Column) -> Column:
        paired = (h["role"] == START) & (F.get(paired_at, s["used"]) == h["pos"])
        closes = (h["role"] == END) & F.array_contains(s["keys"], h["tag"])
        flags = F.struct(F.coalesce(paired, F.lit(False)).alias("paired"), closes.alias("closes"), F.size(s["open"]).alias("count"))
        return F.when(h["role"] == NONE, s).otherwise(then(s, flags, lambda s, f: with_flags(s, h, f)))

    def with_flags(s: Column, h: Column, f: Column) -> Column:
        base, count = s["base"], f["count"]
        # the elements of the innermost pair of tags: left-out ends of rising rank, then inline ones
        above = F.slice(s["open"], base + 1, F.greatest(count - base, F.lit(0)))
        loose = h["optional"] & (((h["role"] == END) & ~f["closes"]) | ((h["role"] == START) & ~f["paired"]))
        ended = place(F.transform(above, lambda e: (e["kind"] == LOOSE) & (e["rank"] >= h["rank"])))
        inline = place(F.transform(above, lambda e: e["kind"] == INLINE))
        # from the top
        same = F.when(h["role"] == END_INLINE, F.array_position(F.reverse(F.transform(above, lambda e: e["key"])), h["tag"])).otherwise(F.lit(0).cast("bigint"))

        def kept(same: Column) -> Column:
            keep = (
                F.when(f["closes"], base - 1)
                .when(loose, F.coalesce(base + F.least(ended, inline) - 1, count))
                .when(f["paired"] & h["rank"].isNotNull(), F.coalesce(base + ended - 1, count))
                .when(same > 0, count - 1)
                .otherwise(count)
            )
            return F.struct(keep.alias("keep"), same.cast("int").alias("same"))

        return then(s, let(same, kept), lambda s, k: with_keep(s, h, f, k))

    def with_keep(s: Column, h: Column, f: Column, k: Column) -> Column:
        opened, base, count, keep = s["open"], s["base"], f["count"], k["keep"]
        parent = F.when(keep > 0, F.get(opened, keep - 1)["pos"])
        gone = F.transform(F.slice(opened, keep + 1, F.greatest(count - keep, F.lit(0))), lambda e: _span(e, h["pos"]))
        void = F.struct(h["pos"].alias("start_pos"), (h["pos"] + 1).alias("end_pos"), parent.alias("parent_pos"), (keep + 1).alias("depth"))
        out = F.when(h["role"] == VOID, F.array(void)).when(keep < count, gone).otherwise(empty(_SPAN))

        def next_(s: Column, out: Column) -> Column:
            opened, base = s["open"], s["base"]
            # where inline elements overlap, they exchange their ends: the innermost one ends, the others move their names up
            moves = (h["role"] == END_INLINE) & (keep < count) & (F.get(opened, count - 1)["key"] != h["tag"])
            moved = F.transform(F.slice(opened, F.lit(1), keep), lambda e, i: F.when(i >= count - k["same"], e.withField("key", F.get(opened, i + 1)["key"])).otherwise(e))
            rest = F.when(keep == count, opened).when(moves, moved).otherwise(F.slice(opened, F.lit(1), keep))
            kind = F.when(h["role"] == START_INLINE, INLINE).when(f["paired"], PAIRED).when(h["optional"], LOOSE).otherwise(OPEN)
            entry = F.struct(
                h["pos"].alias("pos"), kind.alias("kind"), h["rank"].alias("rank"), F.when(h["role"] == START_INLINE, h["tag"]).otherwise("").alias("key"),
                base.alias("base"), parent.alias("parent"), (keep + 1).alias("depth"),
            )
            pushes = h["role"].isin(START, START_INLINE)
            at = F.array_position(s["keys"], h["tag"]).cast("int")
            keys = F.when(f["closes"], F.concat(F.slice(s["keys"], F.lit(1), at - 1), F.slice(s["keys"], at + 1, F.size(s["keys"]))))
            return F.struct(
                F.when(pushes, F.array_append(rest, entry)).otherwise(rest).alias("open"),
                keys.when(f["paired"], F.array_append(s["keys"], h["tag"])).otherwise(s["keys"]).alias("keys"),
                F.when(f["closes"], F.get(opened, base - 1)["base"]).when(f["paired"], keep + 1).otherwise(base).alias("base"),
                (s["used"] + F.when(f["paired"], 1).otherwise(0)).alias("used"),
                piled(s, out),
            )

        return then(s, out, next_)

    def finish(s: Column) -> Column:
        return F.sort_array(F.concat(unpiled(s), F.transform(s["open"], lambda e: _span(e, size))))

    return let(F.reverse(_paired_starts(tags)), lambda paired_at: F.aggregate(tags, start, lambda s, h: merge(s, h, paired_at), finish))


def _span(opened: Column, end: Column) -> Column:
    return F.struct(opened["pos"].alias("start_pos"), end.alias("end_pos"), opened["parent"].alias("parent_pos"), opened["depth"].alias("depth"))

"""Navigation trees: levels to nesting, nesting to indexes and parent paths, paths to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.bind import let
from quire.functions.text import safe_name
from quire.operators.scans import cut, running
from quire.session import settle

#: So many neighbours look for their ancestors among the same rows, about as many as a catalog has levels; a block has as many such parts.
LEVELS = 64
END = (1 << 63) - 1


def nest_depth(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], level: str = "level", small: bool = False
) -> DataFrame:
    """Depth of every item of a flat list with levels: ``depth``, ``idx`` (place among kept items), ``dropped``.

    An item goes at most one below the item before it, so ``depth(i) = min(level(i), depth(i-1) + 1)``, which
    unrolls to ``i + min over j<=i of (level(j) - j)``: a running minimum in place of a stack. Items before
    the first one of level 1 have no place in the tree; they come back with ``dropped`` set.
    """
    lv = F.col(level)
    if not small and "_piece" not in items.columns:
        return nest_depth(cut(items, keys, order), keys, order, level).drop("_piece")
    out = running(items, keys, order, {"_rn": ("sum", F.lit(1)), "_seen": ("max", (lv == 1).cast("int"))}, small)
    out = running(
        out, keys, order,
        {"_low": ("min", lv - F.col("_rn")), "_first": ("min", F.when(lv == 1, F.col("_rn")))}, small,
    )
    kept = F.col("_seen") == 1
    return out.withColumns(
        {
            "depth": F.when(kept, F.col("_rn") + F.col("_low")),
            "idx": F.when(kept, F.col("_rn") - F.col("_first") + 1),
            "dropped": ~kept,
        }
    ).drop("_rn", "_seen", "_low", "_first")


def parents_by_depth(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], small: bool = False
) -> DataFrame:
    """Adds ``parent_idx``: the latest earlier item one level up (as-of by depth), null for roots.

    Every item is seen twice, as a possible parent at its own depth and as a seeker one level up; a running
    ``last`` then finds each seeker's parent without joining the list to itself.
    """
    roles = F.array(
        F.struct(F.col("depth").alias("_at"), F.lit(1).alias("_role"), F.col("idx").alias("_cand")),
        F.struct((F.col("depth") - 1).alias("_at"), F.lit(0).alias("_role"), F.lit(None).cast("bigint").alias("_cand")),
    )
    twin = items.withColumn("_r", F.explode(roles)).select(*items.columns, "_r.*")
    found = running(twin, [*keys, "_at"], [*order, "_role"], {"parent_idx": ("last", F.col("_cand"))}, small)
    return found.where(F.col("_role") == 0).drop("_at", "_role", "_cand")


def nest_catalog(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], level: str = "level", small: bool = False
) -> DataFrame:
    """Flat items with levels to tree rows ``idx, parent_idx, depth``; items without a place are left out.

    Depths, places and parents are scans over one cut of the rows, so they are sorted and settled once.
    """
    if not small and "_piece" not in items.columns:
        return nest_catalog(cut(items, keys, order), keys, order, level).drop("_piece")
    nested = nest_depth(items, keys, order, level, small).where(~F.col("dropped")).drop("dropped")
    return parents_by_depth(nested, keys, order, small)


def dropped_items(items: DataFrame, keys: Sequence[str], order: Sequence[str], level: str = "level", small: bool = False) -> DataFrame:
    """Items per group, and how many of them ``nest_catalog`` leaves out."""
    out = nest_depth(items, keys, order, level, small)
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("dropped").alias("dropped_items")
    )


def preorder_index(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], small: bool = False
) -> DataFrame:
    """``idx``, from 1, over items already ordered as the tree is walked."""
    return running(items, keys, order, {"idx": ("sum", F.lit(1))}, small)


def _blocks(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows gathered into blocks of at most ``LEVELS`` squared neighbours, ``(*keys, _block, _rows)``, settled.

    ``_rows`` is in walking order. A row says up to which ``idx`` it is the last one of its depth (``_until``, as far as the block
    knows) and which row of the block is the first one of its depth (``_first``).
    """
    block = F.col("idx") - F.pmod(F.col("idx"), F.lit(LEVELS**2))
    rows = items.withColumn("_block", block.cast("bigint")).repartition(*keys, "_block")
    level = Window.partitionBy(*keys, "_block", "depth").orderBy("idx")
    rows = rows.withColumns({"_until": F.coalesce(F.lead("idx").over(level).cast("bigint"), F.lit(END)), "_first": F.first("idx").over(level).cast("bigint")})
    row = F.struct(*[c for c in rows.columns if c not in (*keys, "_block")])
    return settle(rows.groupBy(*keys, "_block").agg(F.collect_list(row).alias("_rows")).withColumn("_rows", F.array_sort("_rows", _walk)))


def _walk(a: Column, b: Column) -> Column:
    return F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)


def _ancestor(r: Column) -> Column:
    """A row as others see it above them."""
    here = F.struct(r["title"].alias("title"), r["idx"].cast("bigint").alias("idx"))
    return F.struct(r["depth"].cast("bigint").alias("depth"), r["idx"].cast("bigint").alias("idx"), r["_until"].alias("until"), here.alias("here"))


def _with_note(blocks: DataFrame, notes: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``blocks`` with the array ``name`` that ``notes`` has for some of them."""
    same = F.col("b._block") == F.col("n._block")
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
    found = blocks.alias("b").join(notes.alias("n"), same, "left").select("b.*", F.col(f"n.{name}"))
    return found.withColumn(name, F.coalesce(name, F.array().cast(notes.schema[name].dataType)))


def _with_above(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_above``: of the depths that a block's rows miss in their block, the last row before the block.

    A row at most one level below the one before it misses what that one misses. So seekers are the levels above a block's first
    row, and those that a row skips; what they look among is one row per block and depth.
    """
    skipped = lambda r, i: F.sequence(
        F.coalesce(F.get("_rows", i - 1)["depth"], F.lit(0)).cast("bigint") + 1, r["depth"].cast("bigint") - 1, F.lit(1).cast("bigint")
    )
    jumps = lambda r, i: r["depth"] > F.coalesce(F.get("_rows", i - 1)["depth"], F.lit(0)) + 1
    none = F.array().cast("array<bigint>")
    missed = F.array_distinct(F.flatten(F.transform("_rows", lambda r, i: F.when(jumps(r, i), skipped(r, i)).otherwise(none))))
    missed = F.filter(missed, lambda k: k >= 1)
    last = F.filter("_rows", lambda r: (r["_until"] == END) & (r["depth"] >= 1))
    seen = blocks.select(*keys, "_block", F.explode_outer(F.transform(last, lambda r: F.struct(_ancestor(r).alias("who"), r["_first"].alias("first")))).alias("h"))
    seen = seen.where(F.col("h").isNotNull()).select(*keys, F.col("h.who.depth").alias("_at"), "_block", F.lit(1).alias("_role"), F.col("h.who").alias("_who"), F.col("h.first").alias("_first"))
    seekers = blocks.select(*keys, F.explode_outer(missed).alias("_at"), "_block", F.lit(0).alias("_role")).where(F.col("_at").isNotNull())
    level = Window.partitionBy(*keys, "_at").orderBy("_block", "_role")  # a row per block
    both = seen.unionByName(seekers, allowMissingColumns=True)
    until = F.when(F.lead("_block").over(level) == F.col("_block"), F.lead("_first").over(level))
    found = both.withColumns({"_who": F.last("_who", ignorenulls=True).over(level), "_until": F.coalesce(until, F.lit(END))})
    found = found.where((F.col("_role") == 0) & F.col("_who").isNotNull())
    above = F.collect_list(F.col("_who").withField("until", F.col("_until")))
    return _with_note(blocks, found.groupBy(*keys, "_block").agg(above.alias("_above")), keys, "_above")


def _parts(inner: bool = False) -> Column:
    """A block's rows by ``LEVELS``; of each part the rows before it that are still the last ones of their depth, by depth, and its own.

    A part is ``_smooth`` if all depths above its first row have a row, and none of its rows is more than one level below the one before.
    ``_low`` is the least depth in the part before a row.
    """

    def part(at: Column) -> Column:
        return let(F.slice("_rows", at + 1, F.lit(LEVELS)), lambda rows: described(rows, at))

    def described(rows: Column, at: Column) -> Column:
        start = F.get(rows, F.lit(0))
        before = F.filter(F.slice("_rows", F.lit(1), at), lambda r: (r["_until"] >= start["idx"]) & (r["depth"] >= 1))
        before = F.sort_array(F.concat(F.filter("_above", lambda a: a["until"] >= start["idx"]), F.transform(before, _ancestor)))
        own = F.transform(F.filter(rows, lambda r: r["depth"] >= 1), _ancestor)
        low = lambda i: F.coalesce(F.array_min(F.slice(rows["depth"], F.lit(1), i)).cast("bigint"), F.lit(END))
        placed = F.transform(rows, lambda r, i: r.withField("_low", low(i)))
        steps = F.transform(rows, lambda r, i: (r["depth"] >= 1) & ((i == 0) | (r["depth"] <= F.get(rows, i - 1)["depth"] + 1)))
        full = lambda b: (F.coalesce(F.try_element_at(b, F.lit(-1))["depth"], F.lit(0)) == F.size(b)) & (start["depth"] <= F.size(b) + 1)
        smooth = lambda b: full(b) & F.forall(steps, lambda x: F.coalesce(x, F.lit(False)))
        parents = [F.array_intersect("_inner", rows["idx"].cast("array<bigint>")).alias("_inner")] if inner else []
        return let(before, lambda b: F.struct(placed.alias("_rows"), b.alias("_before"), own.alias("_own"), smooth(b).alias("_smooth"), *parents))

    return F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("_rows") - 1, F.lit(LEVELS)), part))


def _path(idx: Column, depth: Column, low: Column) -> Column:
    """The rows above one of a part, from the root.

    In a smooth part, the rows of the part between its least depth so far and a row's own hold every depth between, in order, and the
    rows before the part hold those above.
    """
    holds = lambda a: (a["idx"] < idx) & (a["until"] > idx) & (a["depth"] < depth)
    outside = F.slice("_before", F.lit(1), (F.least(depth.cast("bigint"), low) - 1).cast("int"))
    return F.when(F.col("_smooth"), F.concat(outside["here"], F.filter("_own", holds)["here"])).otherwise(
        F.sort_array(F.filter(F.concat("_before", "_own"), holds))["here"]
    )


def _with_inner(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_inner``: ``idx`` of a block's rows that others are below."""
    parts = blocks.select(*keys, _parts().alias("p")).select(*keys, "p.*")

    def parent(r: Column, i: Column) -> Column:
        before = F.get("_rows", i - 1)
        above = F.try_element_at(_path(r["idx"], r["depth"], r["_low"]), F.lit(-1))["idx"]
        return F.when((i > 0) & (before["depth"] >= 1) & (before["depth"] + 1 == r["depth"]), before["idx"].cast("bigint")).otherwise(above)

    inner = parts.select(*keys, F.explode_outer(F.array_distinct(F.transform("_rows", parent))).alias("_idx")).where(F.col("_idx").isNotNull())
    inner = inner.withColumn("_block", F.col("_idx") - F.pmod(F.col("_idx"), F.lit(LEVELS**2)))
    return _with_note(blocks, inner.groupBy(*keys, "_block").agg(F.collect_set("_idx").alias("_inner")), keys, "_inner")


def flatten_catalog(
    items: DataFrame, keys: Sequence[str] = ("site",), small: bool = False
) -> DataFrame:
    """Adds ``parent_path`` (ancestors from the root, each with title and idx), ``parent_idx`` and
    ``has_children`` to tree rows ``(*keys, idx, depth, title, url)`` in walking order.

    In walking order the ancestor of a row at depth k is the last earlier row of that depth. Rows are gathered in blocks that are told
    which rows before them count, and paths are made last, within a block: they are neither moved nor written, so that what is
    grows with the rows and not with their depth. Rows without a depth have no ancestors. There is one plan for groups of any size, ``small``
    or not.
    """
    keys = list(keys)
    bare = [c for c in items.columns if c not in ("parent_path", "parent_idx")]
    blocks = _with_inner(_with_above(_blocks(items.select(*bare), keys), keys), keys)
    parts = blocks.select(*keys, _parts(inner=True).alias("p")).select(*keys, "p.*")
    rows = parts.select(*keys, "_before", "_own", "_smooth", "_inner", F.inline_outer("_rows"))
    flat = rows.select(
        *bare, _path(F.col("idx"), F.col("depth"), F.col("_low")).alias("parent_path"),
        F.array_contains("_inner", F.col("idx").cast("bigint")).alias("has_children"),
    )
    flat = flat.withColumn("parent_idx", F.try_element_at("parent_path", F.lit(-1))["idx"])
    columns = [*items.columns, *[c for c in ("parent_path", "parent_idx") if c not in items.columns]]
    return flat.select(*columns, "has_children")


def path_text(parent_path: Column | str = "parent_path") -> Column:
    """The titles above an item, as one text."""
    parent_path = F.col(parent_path) if isinstance(parent_path, str) else parent_path
    return F.array_join(F.transform(parent_path, lambda p: p["title"]), "/")


def output_paths(flat: DataFrame, root: Column | str) -> DataFrame:
    """Adds ``output_path``: ``<root>/<parents…>/<title>/index.md`` for an item with children, else ``<title>.md``."""
    root = F.lit(root) if isinstance(root, str) else root
    folders = F.transform("parent_path", lambda p: safe_name(p["title"]))
    own = safe_name("title")
    file = F.when(F.col("has_children"), F.concat(own, F.lit("/" + K.INDEX_FILE))).otherwise(F.concat(own, F.lit(".md")))
    return flat.withColumn("output_path", F.concat_ws("/", F.array(root), folders, F.array(file)))


def path_collisions(paths: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Paths that more than one item of a catalog leads to; the item with the highest ``idx`` keeps it."""
    return (
        paths.groupBy(*keys, "output_path")
        .agg(F.count(F.lit(1)).alias("items"), F.max("idx").alias("kept_idx"))
        .where(F.col("items") > 1)
    )


def preview_items(flat: DataFrame, keys: Sequence[str] = ("site",), limit: int = K.PREVIEW_ITEMS) -> DataFrame:
    """The first items of each catalog with their title indented by depth."""
    indented = F.concat(F.repeat(F.lit("  "), (F.col("depth") - 1).cast("int")), F.col("title"))
    return flat.where(F.col("idx") <= limit).select(*keys, "idx", "depth", indented.alias("line"))


def count_items(flat: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    return flat.groupBy(*keys).agg(
        F.count_if(F.col("depth") == 1).alias("root_items"), F.count(F.lit(1)).alias("all_items")
    )

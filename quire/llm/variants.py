"""Grouping spelling variants by dense prefix-suffix tiling.

Two words are near if one insertion, deletion or replacement of a code point makes one of the other. That is so exactly if the
length of their common prefix and that of their common suffix add up to the longer word's length less one or more. So
words are laid out as padded matrices of code points, one aligned left and one aligned right, and blocks of words are
compared with each other column by column: a pair's prefix grows as long as its columns agree.

Not every block meets every other. Of a near pair whose longer word has ``size`` code points, the common prefix or the common
suffix has ``size // 2`` at least. So each word stands under its first and its last ``size // 2`` code points, once for its own
length and once as the shorter word of a pair, and only words under the same key are compared. A pair whose prefix is long
enough counts under its prefix, any other one under its suffix, so none counts twice.

A key with more than ``BLOCK`` words is cut into blocks, and every pair of blocks is a tile of its own. A tile has
twice that many words at most; many small tiles are compared at once. A tile returns, for each word, the number of words
near it and the best of them, never pairs.

A word's form is the most frequent word near it (of equal ones the least by code points), if that is ``factor`` times as
frequent as the word. Forms lead to forms, each ``factor`` times as frequent as the one before; the last one is the root.
Roots are found by doubling: a word takes over the root of its root until none has one.

Defined results: null words are left out; an empty table gives an empty one. A word may have any length; words under one
key are compared whole. Words that are given twice count together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import settle

BLOCK = 1024  # words of a key that are one block
ROWS = 1 << 16  # words whose tiles are compared at once
CELLS = 1 << 22  # pairs that are compared at once
_TILE = ("size", "side", "affix", "i", "j")


def _matrices(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``words`` from the first on and from the last on, padded with zero, and lengths."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32) + 1
    for kind in (np.uint8, np.uint16):
        if not len(flat) or flat.max() <= np.iinfo(kind).max:
            flat = flat.astype(kind)
            break
    at = np.arange(lengths.max(initial=0))
    inside = at < lengths[:, None]
    starts = np.cumsum(lengths) - lengths
    left, right = np.zeros(inside.shape, flat.dtype), np.zeros(inside.shape, flat.dtype)
    left[inside] = flat
    right[inside] = flat[((starts + lengths - 1)[:, None] - at)[inside]]
    return left, right, lengths


def _agreeing(columns: np.ndarray) -> np.ndarray:
    """Of ``(tiles, words, columns)``: for each pair of words of a tile, the number of leading columns that agree."""
    tiles, words, width = columns.shape
    out = np.zeros((tiles, words, words), np.uint16)
    alive = np.ones(out.shape, bool)
    for c in range(width):
        alive &= columns[:, :, None, c] == columns[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near_in_tiles(sizes: np.ndarray, suffix: np.ndarray, tile: np.ndarray, cross: np.ndarray, own: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the number of rows of its tile that are near it and the first of them (-1: none).

    Rows of a tile stand together. ``sizes`` is the length of the longer word of the tile's pairs, ``suffix`` says that its words share
    their ends, ``cross`` that only rows of unlike ``own`` are pairs.
    """
    left, right, lengths = _matrices(words)
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    members = np.diff(np.append(starts, len(tile)))
    count, first = np.zeros(len(tile), np.int64), np.full(len(tile), -1)
    width = 1 << np.ceil(np.log2(np.maximum(members, 1))).astype(int)
    kinds = np.unique(np.stack([sizes[starts], suffix[starts], width], 1)[members > 1], axis=0)
    for size, ends, wide in kinds.tolist():
        chosen = np.flatnonzero((sizes[starts] == size) & (suffix[starts] == ends) & (width == wide) & (members > 1))
        half = size // 2
        aligned, other = (right, left) if ends else (left, right)
        for a in range(0, len(chosen), max(1, CELLS // wide**2)):
            some = chosen[a : a + max(1, CELLS // wide**2)]
            filled = np.arange(wide) < members[some][:, None]
            rows = np.where(filled, starts[some][:, None] + np.arange(wide), starts[some][:, None])
            near = filled[:, :, None] & filled[:, None, :]
            near &= ~np.eye(wide, dtype=bool)
            longer = lengths[rows] == size
            near &= longer[:, :, None] | longer[:, None, :]
            near &= ~cross[rows][:, :, None] | (own[rows][:, :, None] != own[rows][:, None, :])
            beyond = _agreeing(other[rows][:, :, :half])
            near &= _agreeing(aligned[rows][:, :, half:size]) + beyond + half >= size - 1
            if ends:
                near &= beyond < half  # else it counts under its prefix
            count[rows[filled]] = near.sum(2)[filled]
            first[rows[filled]] = np.where(near.any(2), starts[some][:, None] + near.argmax(2), -1)[filled]
    return count, first


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, in a tile by falling ``n``, to ``(word, near, form, form_n)``."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        col = {name: rows.column(name).combine_chunks() if rows.num_rows else rows.column(name) for name in rows.column_names}
        tile = np.cumsum(_changes(rows))
        i, j = (col[c].to_numpy(zero_copy_only=False) for c in "ij")
        size = col["size"].to_numpy(zero_copy_only=False).astype(np.int64)
        count, first = near_in_tiles(size, pc.equal(col["side"], "s").to_numpy(zero_copy_only=False), tile, i != j, col["own"].to_numpy(zero_copy_only=False), col["word"])
        hit = np.flatnonzero(count)
        columns = [col["word"].take(hit), pa.array(count[hit]), col["word"].take(first[hit]), col["n"].take(first[hit])]
        return pa.RecordBatch.from_arrays(columns, ["word", "near", "form", "form_n"])

    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.num_rows
        if total >= ROWS:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(rows))[-1])  # the last tile may go on
            if last:
                yield found(rows.slice(0, last))
            held = rows.slice(last).to_batches()
            total = rows.num_rows - last
    if total:
        yield found(pa.Table.from_batches(held))


def _changes(rows: pa.Table) -> np.ndarray:
    """Where a tile begins."""
    out = np.zeros(rows.num_rows, bool)
    for name in _TILE:
        column = rows.column(name).combine_chunks()
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    out[:1] = True
    return out


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, n, n_near, near, near_n)`` of distinct words ``(word, n)``: how many words are near, and the most frequent of them."""
    length = F.length("word")

    def under(size: Column) -> list[Column]:
        half = (size / 2).cast("int")
        return [F.struct(size.alias("size"), F.lit(side).alias("side"), cut("word", half).alias("affix")) for side, cut in (("p", F.left), ("s", F.right))]

    keyed = counted.select("word", "n", F.explode(F.array(*under(length), *under(length + 1))).alias("k")).select("k.*", "word", "n")
    # keys that take more than one block: no more than there are blocks
    large = keyed.groupBy("size", "side", "affix").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > BLOCK)
    large = large.withColumn("_blocks", F.ceil(F.col("_c") / BLOCK).cast("int")).drop("_c")
    blocks = F.coalesce("_blocks", F.lit(1))
    tiled = keyed.join(large, ["size", "side", "affix"], "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    tiled = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiled = tiled.select("size", "side", "affix", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "word", "n")
    dealt = tiled.repartition(*_TILE).sortWithinPartitions(*_TILE, F.desc("n"), "word")
    found = dealt.mapInArrow(_compare, "word string, near long, form string, form_n long")
    none = [F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("form_n")]
    every = counted.select("word", "n", *none).unionByName(found, allowMissingColumns=True)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.form").alias("near"), (-F.col("b.m")).alias("near_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form, from ``(word, form)``: the last one that forms lead to."""
    known = settle(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        known = settle(known.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = known.where("_moved").take(1)
        known = known.drop("_moved")
        if not moved:
            return known


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of counted words ``(word, n)``."""
    counted = settle(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(counted)
    enough = F.col("near_n") >= factor * F.col("n")
    formed = settle(near.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")))
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))

"""Sharding by extendible hashing.

A directory is indexed by the first bits of a key's hash. A bucket whose documents exceed the byte limit is split on
the next bit, and only that bucket, until all fit; so shards differ in depth and adding documents moves only
those of the buckets that overflow. Several bits are looked at per round: a histogram by prefix gives the sums of
all its shorter prefixes, and every prefix takes the shortest one that fits.

Rows of one hash can't be told apart by more bits of it. If a bucket overflows and all its rows have one hash, their
row numbers, hashed, give further bits. A document above the limit is a shard by itself, whose ``shard_bytes``
shows it. Nothing is dropped or cut.

Defined results: a null text has no bytes; a null key is hashed like an empty one; rows that repeat are dealt out
each by itself; an empty table has no shards.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import settle

BITS = 60  # of the first hash; as many follow from the row number
STEP = 6  # more bits looked at in a round


def _hash(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string")), 1, BITS // 4), 16, 10).cast("bigint")


def _bits(value: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


def _split(rows: DataFrame, limit: int, size: int, head: str = "") -> tuple[DataFrame, DataFrame | None]:
    """Rows ``(…, _h, bytes, _head)`` whose bucket fits, with ``shard, depth, shard_bytes, shard_docs``, and those that
    more bits of ``_h`` can't help, or None."""
    done: DataFrame | None = None
    stuck: DataFrame | None = None
    low, high = 0, min(BITS, max(1, ceil(log2(max(1, size / limit)))) + 3)
    while True:
        here = rows.withColumn("_p", F.shiftrightunsigned("_h", BITS - high))
        sums = (
            here.groupBy("_head", "_p")
            .agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("least"), F.max("_h").alias("most"))
            .withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .withColumn("a", F.expr(f"shiftrightunsigned(_p, {high} - k)"))
        )
        fits = sums.groupBy("_head", "k", "a").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
        leaf = sums.join(fits, ["_head", "k", "a"], "left").groupBy("_head", "_p").agg(
            F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("k", "shard_bytes", "shard_docs"))).alias("_leaf"),
            F.first(F.col("least") == F.col("most")).alias("_alike"),
        )
        looked_up = settle(here.join(leaf, ["_head", "_p"]))
        fit = looked_up.where(F.col("_leaf").isNotNull()).withColumns(
            {"depth": F.col("_leaf.k"), "shard_bytes": F.col("_leaf.shard_bytes"), "shard_docs": F.col("_leaf.shard_docs")}
        )
        prefix = F.expr(f"shiftrightunsigned(_p, {high} - depth)")
        fit = fit.withColumn("shard", F.concat("_head", _bits(prefix, F.col("depth")))).drop("_p", "_leaf", "_alike")
        done = fit if done is None else done.unionByName(fit)
        over = looked_up.where(F.col("_leaf").isNull())
        alike = over.where(F.col("_alike")).drop("_p", "_leaf", "_alike")
        stuck = alike if stuck is None else stuck.unionByName(alike)
        rows = over.where(~F.col("_alike")).drop("_p", "_leaf", "_alike")
        if not rows.take(1):
            return done, stuck if stuck.take(1) else None
        low, high = high + 1, min(BITS, high + STEP)


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, bytes, shard, depth, shard_bytes, shard_docs)``; ``shard`` is the prefix of bits that leads to it."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = settle(rows.withColumns({"_h": _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "_head": F.lit("")}))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    names = ["doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    done, stuck = _split(rows.where(F.col("bytes") <= limit), limit, size)
    out = done.select(*names)
    if stuck is not None:
        again = stuck.withColumns({"_head": F.concat("_head", _bits(F.col("_h"), BITS)), "_h": _hash(F.col("_row"))})
        more, rest = _split(again, limit, size)
        assert rest is None  # row numbers differ
        out = out.unionByName(more.withColumn("depth", F.col("depth") + BITS).select(*names))
    alone = rows.where(F.col("bytes") > limit)
    alone = alone.withColumn("shard", F.concat(_bits(F.col("_h"), BITS), _bits(_hash(F.col("_row")), BITS)))
    alone = alone.withColumns({"depth": F.lit(2 * BITS), "shard_bytes": F.col("bytes"), "shard_docs": F.lit(1).cast("bigint")})
    return out.unionByName(alone.select(*names))

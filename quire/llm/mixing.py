"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a fixed shuffled order, once more behind the first time if the source has to give more
than it has. Each copy's virtual finish time is what its source has given with it, in words, divided by what the
source is to give; sorted by it over all sources, copies interleave in the right proportion at every point, and the
mix ends where the budget is used up. A copy in service when its source has given its share is cut there.

Sums along a source and along the mix are taken in ranges, so no source has to fit a task.

Defined results: a null text has no words, is in the mix with nothing, and costs nothing; rows that repeat are
queued each by itself; a null source is a source, the last one; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import word_count
from quire.operators.scans import running


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, times: float = 2.0) -> DataFrame:
    """``(source, source_size, target, budget)``.

    Sources weigh ``weights`` in turn, by code point, null last. ``share`` of all words is dealt out by weight; a
    source gives ``times`` its words at most, and what it can't give is dealt out among the others again. So a
    target is the smaller of that limit and weight times a level common to all, and the level follows from the
    sources in the order in which they reach their limits. There is one row per source here.
    """
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(turn) - 1) % len(weights))
    out = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(times))
    whole = Window.partitionBy()
    out = out.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share)).withColumn("_full", F.col("_cap") / F.col("_w"))
    filling = Window.orderBy("_full", F.col("source").isNull(), "source")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_full"), F.col("source").isNull().desc(), F.desc("source"))
    level = (F.col("budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_level", level)
    open_ = F.when(F.col("_level") < F.col("_full"), F.struct("_full", F.col("source").isNull(), "source"))
    out = out.withColumn("_level", F.min_by("_level", open_).over(whole))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return out.select("source", "source_size", target.alias("target"), F.floor("budget").alias("budget"))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text", source: str = "source",
        copies: int = 2, **weighing) -> DataFrame:
    """The mix: ``copies`` rows for every document, ``(*keep, mix_row, source, size, source_size, target, copy,
    finish, taken)``. ``finish`` orders the mix; ``taken`` is the number of words it takes of that copy, from the first on.
    ``mix_row`` numbers the rows of ``docs``. A kept column with a name of
    these gets ``_of_doc`` behind it."""
    sizes = docs.select(
        *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(source).alias("source"), word_count(text).alias("size"),
        F.monotonically_increasing_id().alias("mix_row"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_turn"),
    )
    queued = running(sizes, ["source"], ["_turn", "size", "mix_row"], {"_given": ("sum", F.col("size"))})
    goal = targets(queued.select("source", "size"), times=float(copies), **weighing).withColumnRenamed("source", "_s")
    queued = queued.join(goal, queued["source"].eqNullSafe(goal["_s"])).drop("_s")
    queued = queued.withColumn("copy", F.explode(F.array(*map(F.lit, range(copies)))))
    begin = F.col("copy") * F.col("source_size") + F.col("_given") - F.col("size")
    in_share = F.least(F.greatest(F.floor("target") - begin, F.lit(0)), F.col("size"))
    finish = F.coalesce(F.try_divide(begin + F.col("size"), F.col("target")), F.lit(0.0))
    queued = queued.withColumns({"finish": finish, "_share": in_share})
    merged = running(queued, [], ["finish", "mix_row", "copy"], {"_total": ("sum", F.col("_share"))})
    left = F.col("budget") - F.col("_total") + F.col("_share")
    taken = F.greatest(F.least(left, F.col("_share")), F.lit(0))
    own = {"mix_row", "source", "size", "source_size", "target", "copy", "finish", "taken"}
    named: list[Column | str] = [F.col(f"_keep_{c}").alias(f"{c}_of_doc" if c in own else c) for c in keep]
    return merged.select(*named, "mix_row", "source", "size", "source_size", "target", "copy", "finish", taken.cast("bigint").alias("taken"))


def taken_words(mixed: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document again, with the words taken of all its copies."""
    out = mixed.groupBy("mix_row").agg(*[F.first(c).alias(c) for c in [*keep, "size", "source_size", "target"]], F.sum("taken").alias("taken"))
    return out.select(*keep, "size", "source_size", "target", "taken")

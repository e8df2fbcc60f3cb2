"""Running aggregates over groups of any size.

A window puts a whole group into one task, which is right where a group is one document. Any other group is
scanned in pieces: rows are cut into ranges of ``(group, order)``, each range is scanned by itself, and what
the ranges before it add up to is carried in. The result is the same, nulls included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settle

# what a scan can do -> (aggregate of rows, how a carried value and a local one combine)
_AGGREGATES = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in settled ranges of ``(keys, order)``, with the number of each row's range as ``_piece``.

    Several scans of the same groups, or of parts of them in the same order, can share one cut.
    """
    return settle(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outs: dict[str, tuple[str, object]], small: bool = False
) -> DataFrame:
    """Add ``outs``, running aggregates up to and with the current row, per ``keys`` in ``order``.

    ``order`` has to be unique within a group. ``small`` says that every group is a part of one document;
    only then a group is scanned whole. Otherwise rows are settled once, range by range, because the ranges
    are read twice: for their totals and for their rows. Rows that come from ``cut`` are scanned as they lie, and keep ``_piece``.
    """
    keys, order = list(keys), list(order)
    if small:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: _AGGREGATES[kind][0](c).over(w) for name, (kind, c) in outs.items()})

    values = {f"_v_{name}": c for name, (_, c) in outs.items()}
    pieces = df.withColumns(values) if "_piece" in df.columns else cut(df.withColumns(values), keys, order)
    totals = []
    for name, (kind, _) in outs.items():
        v = F.col(f"_v_{name}")
        if kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"_c_{name}"))
        else:
            totals.append(_AGGREGATES[kind][0](v).alias(f"_c_{name}"))
    # one row per piece and group: as few per group as there are pieces
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.groupBy(*keys, "_piece").agg(*totals)
    carried = carried.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_piece").alias("_p"),
        *[_AGGREGATES[kind][0](F.col(f"_c_{name}")).over(before).alias(f"_c_{name}") for name, (kind, _) in outs.items()],
    )
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = pieces.withColumns({f"_l_{name}": _AGGREGATES[kind][0](F.col(f"_v_{name}")).over(inside) for name, (kind, _) in outs.items()})
    done = scanned.join(carried, same, "left").withColumns(
        {name: _AGGREGATES[kind][1](F.col(f"_c_{name}"), F.col(f"_l_{name}")) for name, (kind, _) in outs.items()}
    )
    return done.select(*df.columns, *outs)

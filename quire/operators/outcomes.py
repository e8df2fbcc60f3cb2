"""What became of a run: retries, totals, progress, error classes, words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.scans import running


def retry_outcome(
    attempts: DataFrame, retries: int, keys: Sequence[str] = ("url",), order: Sequence[str] = ("attempt",)
) -> DataFrame:
    """Fold an attempt log (``error`` is null for a success) into one outcome per key.

    Only the first ``retries + 1`` attempts count. The first success ends the series; without one the last
    error is the outcome. The row limit is applied before the shuffle, so a long series costs no more than
    a short one.
    """
    if retries < 0:
        raise ValueError("retries must not be negative")
    turn = Window.partitionBy(*keys).orderBy(*order)
    tried = attempts.withColumn("_try", F.row_number().over(turn)).where(F.col("_try") <= retries + 1)
    won = F.min(F.when(F.col("error").isNull(), F.col("_try")))
    return (
        tried.groupBy(*keys)
        .agg(won.alias("_won"), F.max("_try").alias("_last"), F.max_by("error", "_try").alias("_error"))
        .select(
            *keys,
            F.coalesce("_won", "_last").cast("bigint").alias("attempts"),
            F.col("_won").isNotNull().alias("success"),
            F.when(F.col("_won").isNull(), F.col("_error")).alias("error"),
        )
    )


def run_totals(results: DataFrame, keys: Sequence[str] = (), total: DataFrame | None = None) -> DataFrame:
    """``total, completed, failed, percent``; failures do not move the percentage.

    ``total`` is a one-row frame with the planned number where a run was stopped before its end.
    """
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("completed"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    if total is not None:
        planned = total.select(F.col("total").alias("_planned")).first()[0]
        out = out.withColumn("total", F.lit(planned).cast("bigint"))
    return out.withColumn("percent", F.col("completed") / F.nullif(F.col("total"), F.lit(0)) * 100)


def running_progress(
    results: DataFrame, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Completed and failed so far, after each result."""
    done = F.col("success").cast("bigint")
    return running(results, keys, order, {"completed": ("sum", done), "failed": ("sum", 1 - done)})


# --- fixed values: the classes an error can have -----------------------------------------------------------
ERROR_CLASSES = ["render", "parse", "content_not_found", "convert", "write"]


def error_breakdown(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failures by class; the class is what stands before the first colon of the error."""
    cls = F.split_part(F.col("error"), F.lit(":"), F.lit(1))
    known = F.when(cls.isin(ERROR_CLASSES), cls).otherwise("other")
    return results.where(~F.col("success")).groupBy(*keys, known.alias("error_class")).agg(F.count(F.lit(1)).alias("failures"))


def word_totals(results: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("word_count").cast("bigint").alias("words")
    )

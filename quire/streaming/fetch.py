"""The same work over pages that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.fetch import fetch_placed, latest_html, place_items
from quire.session import settle
from quire.sources.markdown_files import read_markdown, write_markdown


def stream_fetch(
    pages: DataFrame,
    items: DataFrame,
    catalogs: DataFrame,
    root: str,
    output: str,
    checkpoint: str,
    keys: Sequence[str] = ("site",),
    on_batch: Callable[[int, DataFrame], None] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Convert pages as they arrive and append the documents to ``output``.

    Items are placed once; each batch fetches those whose pages it brought. What ``output`` already holds
    is skipped, so a batch that is run again after a failure, or a page that comes twice, writes nothing new;
    stopping loses no finished work. ``on_batch`` gets the number and the results of every batch.
    """

    placed = settle(place_items(items, catalogs, root, keys))

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        wave = batch.groupBy("url").agg(latest_html(batch).alias("html"))
        try:
            done = read_markdown(spark, output)
        except AnalysisException:
            done = None  # nothing has been written yet
        due = placed.join(batch.select("url"), "url", "left_semi")
        fetch = fetch_placed(due, wave, done=done, keys=keys, **options)
        write_markdown(fetch.documents, output)
        if on_batch is not None:
            on_batch(number, fetch.results)

    return (
        pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_progress(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running totals of a stream of results ``(success)``; write it in ``complete`` or ``update`` mode."""
    grouped = results.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("success").cast("bigint")).alias("completed"),
        F.sum((~F.col("success")).cast("bigint")).alias("failed"),
    )

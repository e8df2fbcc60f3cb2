"""Catalog items to Markdown documents: flatten, place, skip what is done, find the page, convert."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import url_hash
from quire.operators.markdown import convert_wanted, normal_selector
from quire.operators.tree import flatten_catalog, output_paths
from quire.session import settle


class Fetch(NamedTuple):
    """The parts of one job. Whoever wants several of them should write ``table`` once and select from that."""

    table: DataFrame  # results with ``content`` and ``keeps_path``
    results: DataFrame  # one row per item: what became of it
    documents: DataFrame  # (site, output_path, content): what is to be written
    new_pages: DataFrame  # (url, html): what the cache does not hold yet


def latest_html(pages: DataFrame) -> Column:
    """Aggregate: the html of the latest row, by ``fetched_at`` if there is such a column, then by the text."""
    order = ["fetched_at", "html"] if "fetched_at" in pages.columns else ["html"]
    return F.max_by("html", F.struct(*order))


def find_pages(work: DataFrame, pages: DataFrame, cache: DataFrame | None) -> DataFrame:
    """``work`` with ``html`` and ``from_cache``: the cached page of an address if there is one, else the page.

    Of several pages with one address the latest by ``fetched_at`` counts, where there is that column, and of
    equally late ones the greatest text; the same holds for the cache. Pages that nobody asks for are dropped before
    they are moved.
    """
    asked = work.select("url_hash").distinct()
    live = pages.withColumn("url_hash", url_hash("url")).join(asked, "url_hash", "left_semi")
    # as many tasks as there are shuffle partitions, however small their rows: what follows is work per page; a broadcast
    # join would leave the rows in the few tasks that read the work
    tasks = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = live.repartition(tasks, "url_hash").groupBy("url_hash").agg(latest_html(pages).alias("_live"))
    found = work.join(live.hint("merge"), "url_hash", "left")
    if cache is None:
        return found.withColumn("html", F.col("_live")).withColumn("from_cache", F.lit(False)).drop("_live")
    kept = cache.join(asked, "url_hash", "left_semi")
    kept = kept.groupBy("url_hash").agg(latest_html(cache).alias("_kept"), F.lit(True).alias("_hit"))
    found = found.join(kept.hint("merge"), "url_hash", "left")
    hit = F.col("_hit").isNotNull()
    return found.withColumns({"html": F.when(hit, F.col("_kept")).otherwise(F.col("_live")), "from_cache": hit}).drop(
        "_live", "_kept", "_hit"
    )


def place_items(items: DataFrame, catalogs: DataFrame, root: str, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Items with the file they go to and the selector they are read with.

    ``items`` are tree rows ``(*keys, idx, depth, title, url)``, ``catalogs`` one row per ``keys`` with
    ``selectors``; ``want`` is the catalog's content selector and type, null without a catalog.
    """
    keys = list(keys)
    flat = flatten_catalog(items, keys)
    site_root = F.concat_ws("/", F.lit(root), *[F.col(k).cast("string") for k in keys])
    want = normal_selector(F.col("selectors.content"), F.col("selectors.content_type"))
    chosen = catalogs.select(*keys, want.alias("want"))
    placed = output_paths(flat, site_root).join(chosen, keys, "left").withColumn("url_hash", url_hash("url"))
    # where several items lead to one path, the one with the highest idx keeps it
    winners = placed.groupBy("output_path").agg(F.max("idx").alias("_kept"))
    placed = placed.join(winners, "output_path").withColumn("keeps_path", F.col("idx") == F.col("_kept"))
    return placed.select(*keys, "idx", "title", "url", "url_hash", "want", "output_path", "keeps_path")


def fetch_placed(
    placed: DataFrame,
    pages: DataFrame,
    cache: DataFrame | None = None,
    done: DataFrame | None = None,
    keys: Sequence[str] = ("site",),
    **options,
) -> Fetch:
    """Fetch items that have their place.

    ``done`` is ``(output_path, source)`` of what has been written. An item counts as done when its path and
    its address are both there; it succeeds with no words. An address that several items name is taken apart
    once, and converted once per selector. An item that does not keep its path has a result, but writes no document; so a run
    that is repeated has nothing to write. An item whose selector is outside the grammar has an error of its own.
    """
    keys = list(keys)
    if done is None:
        placed = placed.withColumn("skipped", F.lit(False))
    else:
        written = done.select("output_path", F.col("source").alias("url"), F.lit(True).alias("skipped")).distinct()
        placed = placed.join(written, ["output_path", "url"], "left")
        placed = placed.withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    placed = settle(placed)  # every part of the job reads it
    work = placed.where(~F.col("skipped") & F.col("want").isNotNull()).groupBy("url_hash").agg(F.max("url").alias("url"), F.collect_set("want").alias("wants"))
    found = find_pages(work, pages, cache).withColumn("missing", F.col("html").isNull())
    outcome = convert_wanted(found, ("url_hash",), carry=("from_cache", "missing"), **options)
    outcome = outcome.withColumn("want", F.struct("selector", "type")).drop("url", "title", "body", "selector", "type")
    skipped, converted_now = F.col("skipped"), F.col("content").isNotNull()
    results = placed.join(outcome, ["url_hash", "want"], "left").select(
        *keys, "idx", "title", "url", "output_path", "skipped", "from_cache",
        F.when(converted_now, F.col("word_count")).otherwise(0).cast("bigint").alias("word_count"),
        (skipped | converted_now).alias("success"),
        F.when(skipped, None)
        .when(F.col("want").isNull(), "parse: no usable selector")
        .when(F.col("missing"), "render: page not available")
        .otherwise(F.col("error"))
        .alias("error"),
        F.when(~skipped, F.col("content")).alias("content"), "keeps_path",
    )
    results = results.withColumn("from_cache", F.when(~F.col("skipped"), F.col("from_cache")))
    site = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    fresh = results.where(F.col("keeps_path") & F.col("content").isNotNull()).withColumn("site", site)
    unseen = found.where(~F.col("from_cache") & F.col("html").isNotNull())
    return Fetch(
        table=results,
        results=results.drop("content", "keeps_path"),
        documents=fresh.select("site", "output_path", F.col("url").alias("source"), "content"),
        new_pages=unseen.groupBy("url_hash").agg(F.max("url").alias("url"), F.max("html").alias("html")).drop("url_hash"),
    )


def fetch_corpus(
    items: DataFrame,
    catalogs: DataFrame,
    pages: DataFrame,
    root: str,
    cache: DataFrame | None = None,
    done: DataFrame | None = None,
    keys: Sequence[str] = ("site",),
    **options,
) -> Fetch:
    """Fetch all items of all catalogs: ``place_items``, then ``fetch_placed``."""
    return fetch_placed(place_items(items, catalogs, root, keys), pages, cache, done, keys, **options)

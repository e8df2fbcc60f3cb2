"""Navigation and content regions of pages: candidate selectors, their scores, the links of the best one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions import urls
from quire.functions.bind import let
from quire.functions.text import trim_unicode, with_names
from quire.operators.html import attr, inner_text, shredded
from quire.operators.selectors import hits
from quire.operators.tree import nest_catalog

_TOC = [(s, "css") for s, _ in K.TOC_CANDIDATES]
_CONTENT = [(s, "css") for s in K.CONTENT_CANDIDATES]


def _toc_names() -> Column:
    return F.array(*[F.lit(s) for s, _ in K.TOC_CANDIDATES])


def _toc_weights() -> Column:
    return F.array(*[F.lit(w) for _, w in K.TOC_CANDIDATES])


_LISTS = {"level": lambda e: e["tag"].isin("ul", "ol")}


def _links(found: Callable[[Column], Column] | Column, own: Callable[[Column], Column], titles: bool = False) -> Column:
    """Matched elements as links, in document order: ``array<struct<start_pos, end_pos, href, target, level, valid, hits[, title]>>``.

    ``own`` picks the hits that count; a link without one is left out. Needs the page's ``url`` and, for titles, ``tokens``. ``found``
    are the hits, or what makes them with the table of named references.
    """

    def of(names: Column) -> Column:
        def link(h: Column) -> Column:
            fields = [h["start_pos"].alias("start_pos"), h["end_pos"].alias("end_pos")]
            title = [trim_unicode(inner_text(F.col("tokens"), h["start_pos"], h["end_pos"], names)).alias("title")] if titles else []
            rest = [F.greatest(h["level"], F.lit(1)).alias("level")]

            def with_target(href: Column, target: Column) -> Column:
                valid = F.coalesce(urls.host(target) == urls.host("url"), F.lit(False))
                return F.struct(*fields, href.alias("href"), target.alias("target"), *rest, valid.alias("valid"), own(h["hits"]).alias("hits"), *title)

            resolve = lambda href: F.when(href != "", urls.resolve(F.col("url"), href))
            return let(attr("href", h["raw"], names), lambda href: let(resolve(href), lambda target: with_target(href, target)))

        matched = found(names) if callable(found) else found
        return F.transform(F.filter(matched, lambda h: F.size(own(h["hits"])) > 0), link)

    return with_names(of)


def toc_hits(pages: DataFrame) -> DataFrame:
    """Elements matched by any navigation candidate, with list level, target and whether it is on the host.

    ``(page_id, url, start_pos, end_pos, hits, level, href, target, valid)``.
    """
    rows = shredded(pages, ("page_id",), "url")
    links = _links(lambda names: hits(F.col("elements"), _TOC, _LISTS, names=names), lambda h: h)
    rows = rows.select("page_id", "url", F.explode_outer(links).alias("l")).where(F.col("l").isNotNull())
    return rows.select("page_id", "url", "l.*")


def toc_scores(pages: DataFrame) -> DataFrame:
    """Score of every candidate with enough links on a page: links on the same host times its weight.

    Links are counted before any filter, and their titles are not looked at.
    """
    found = toc_hits(pages)
    counted = (
        found.select("page_id", F.explode("hits").alias("selector_id"), "valid")
        .groupBy("page_id", "selector_id")
        .agg(F.count(F.lit(1)).alias("links"), F.count_if("valid").alias("valid_links"))
        .where(F.col("links") >= K.MIN_TOC_LINKS)
    )
    return counted.select(
        "page_id", "selector_id", F.get(_toc_names(), F.col("selector_id")).alias("selector"), "links", "valid_links",
        (F.col("valid_links") * F.get(_toc_weights(), F.col("selector_id"))).alias("score"),
    )


def best_toc(scores: DataFrame) -> DataFrame:
    """The candidate with the highest score; the earlier one wins a tie, and a score of zero never wins."""
    rank = F.struct(F.col("score"), -F.col("selector_id"))
    best = scores.where(F.col("score") > 0).groupBy("page_id").agg(
        F.max_by(F.struct("selector_id", "selector", "valid_links", "score"), rank).alias("b")
    )
    return best.select("page_id", "b.*")


def toc_links(pages: DataFrame, selector_id: int | None = None) -> DataFrame:
    """Links of navigation candidates in document order: ``(page_id, selector_id, ord, title, href, url, level)``.

    Only links with a title and a target on the page's own host are kept.
    """
    rows = shredded(pages, ("page_id",), "url")
    own = (lambda h: h) if selector_id is None else (lambda h: F.filter(h, lambda x: x == selector_id))
    links = _links(lambda names: hits(F.col("elements"), _TOC, _LISTS, names=names), own, titles=True)
    links = F.filter(links, lambda l: l["valid"] & (l["title"] != ""))
    rows = rows.select("page_id", F.explode_outer(links).alias("l")).where(F.col("l").isNotNull())
    rows = rows.select("page_id", F.explode("l.hits").alias("selector_id"), "l.*")
    return rows.select(
        "page_id", "selector_id", F.col("start_pos").alias("ord"), "title", "href", F.col("target").alias("url"), "level"
    )


def detect_content(pages: DataFrame) -> DataFrame:
    """The first content candidate that matches anything on a page, else ``body``."""
    best = F.array_min(F.flatten(F.transform(hits(F.col("elements"), _CONTENT), lambda h: h["hits"])))
    named = F.coalesce(F.get(F.array(*[F.lit(s) for s in K.CONTENT_CANDIDATES]), F.col("_id")), F.lit("body"))
    return shredded(pages).select("page_id", best.alias("_id")).select("page_id", named.alias("selector"))


def detect_regions(pages: DataFrame) -> DataFrame:
    """Navigation and content of every page in one pass over its elements.

    ``(page_id, url, toc, toc_score, confidence, content, root_items, links, error)``; ``links`` are those of
    the best navigation candidate that have a title and stay on the host, in document order. A page without
    navigation comes back with ``error``.
    """
    n = len(_TOC)
    rows = shredded(pages, ("page_id",), "url").withColumn("found", hits(F.col("elements"), _TOC + _CONTENT, _LISTS)).drop("elements")
    links = _links(F.col("found"), lambda h: F.filter(h, lambda x: x < n), titles=True)
    content = F.array_min(F.filter(F.flatten(F.transform("found", lambda h: h["hits"])), lambda x: x >= n))
    per_page = rows.select("page_id", "url", links.alias("links"), content.alias("_content"))
    ids = F.array(*[F.lit(i) for i in range(n)])

    def score(i: Column) -> Column:
        all_links = F.filter("links", lambda l: F.array_contains(l["hits"], i))
        valid = F.size(F.filter(all_links, lambda l: l["valid"]))
        points = F.when(F.size(all_links) >= K.MIN_TOC_LINKS, valid * F.get(_toc_weights(), i)).otherwise(F.lit(0.0))
        return F.struct(points.alias("score"), (-i).alias("turn"))

    per_page = per_page.withColumn("best", F.array_max(F.transform(ids, score)))
    won = F.coalesce(F.col("best.score") > 0, F.lit(False))
    chosen = F.filter(
        "links", lambda l: won & l["valid"] & F.array_contains(l["hits"], -F.col("best.turn")) & (l["title"] != "")
    )
    kept = per_page.withColumn("links", F.coalesce(chosen, F.array()))
    roots = F.size(F.filter("links", lambda l: l["level"] == 1)).cast("bigint")
    named = F.coalesce(
        F.get(F.array(*[F.lit(s) for s in K.CONTENT_CANDIDATES]), F.col("_content") - n), F.lit("body")
    )
    kept = kept.withColumn("root_items", roots)
    return kept.select(
        "page_id", "url",
        F.when(won, F.get(_toc_names(), -F.col("best.turn"))).alias("toc"),
        F.when(won, F.col("best.score")).alias("toc_score"),
        F.when(won, F.least(F.lit(1.0), F.col("best.score") / (F.col("root_items") + 1))).alias("confidence"),
        named.alias("content"), "root_items", "links",
        F.when(urls.host("url").isNull(), "bad_url").when(~won, "toc_not_found").alias("error"),
    )


def catalog_items(regions: DataFrame) -> DataFrame:
    """Tree rows ``(page_id, idx, parent_idx, depth, title, url)`` of detected navigation."""
    links = regions.where(F.col("error").isNull()).select("page_id", F.explode("links").alias("l"))
    flat = links.select("page_id", F.col("l.start_pos").alias("ord"), "l.level", "l.title", F.col("l.target").alias("url"))
    nested = nest_catalog(flat, ["page_id"], ["ord"], small=True)
    return nested.select("page_id", "idx", "parent_idx", "depth", "title", "url")


def collapsed_nav(pages: DataFrame) -> DataFrame:
    """How many elements of folded-up navigation each page holds, by selector; its catalog is likely short."""
    names = F.array(*[F.lit(s) for s in K.COLLAPSED_SELECTORS])
    found = hits(F.col("elements"), [(s, "css") for s in K.COLLAPSED_SELECTORS])
    ids = F.flatten(F.transform(found, lambda h: h["hits"]))
    rows = shredded(pages).select("page_id", F.explode_outer(ids).alias("_id")).where(F.col("_id").isNotNull())
    return rows.groupBy("page_id", F.get(names, F.col("_id")).alias("selector")).agg(F.count(F.lit(1)).alias("elements"))

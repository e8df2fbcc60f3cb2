"""Pages to catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators.toc import catalog_items, detect_regions
from quire.session import settle


def scan_catalogs(
    pages: DataFrame, scanned_at: Column | None = None, ai_generated: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(catalogs, items)`` of all pages, one catalog per page.

    Catalogs are ``(page_id, site, url, selectors, ai_generated, confidence, root_items, scanned_at, error)``,
    items tree rows ``(page_id, idx, parent_idx, depth, title, url)``. A page without navigation keeps its row
    and says so in ``error``. Pages are taken apart once: both tables are read from one settled result.
    """
    regions = settle(detect_regions(pages))
    now = F.current_timestamp() if scanned_at is None else scanned_at
    catalogs = regions.select(
        "page_id", urls.host("url").alias("site"), "url",
        F.struct(
            F.col("toc"), F.col("content"),
            F.lit(None).cast("string").alias("toc_type"), F.lit(None).cast("string").alias("content_type"),
        ).alias("selectors"),
        F.lit(ai_generated).alias("ai_generated"), "confidence", "root_items",
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scanned_at"), "error",
    )
    return catalogs, catalog_items(regions)

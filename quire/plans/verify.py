"""Selector checks over a corpus, and what they change in catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import preview_head, preview_rest
from quire.functions.urls import host, url_hash
from quire.operators.markdown import convert_wanted, normal_selector
from quire.operators.selectors import SELECTOR_TYPES
from quire.plans.fetch import find_pages


def resolve_selector(requests: DataFrame, catalogs: DataFrame, key: str = "site") -> DataFrame:
    """Which selector a check uses: ``requests (key, selector, type)`` with ``selector``, ``type``, ``error``.

    A selector that is given wins, with its type or css. Else the catalog's is taken with the catalog's type,
    whatever type was given.
    """
    own = F.nullif(F.col("selector"), F.lit(""))
    theirs = F.nullif(F.col("_content"), F.lit(""))
    kind = F.when(own.isNotNull(), F.col("type")).otherwise(F.col("_kind"))
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit("css"))
    known = catalogs.select(
        key, F.col("selectors.content").alias("_content"), F.col("selectors.content_type").alias("_kind")
    )
    wrong = ~F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("css")).isin(*SELECTOR_TYPES)
    error = F.when(wrong, "type").when(F.coalesce(own, theirs).isNull(), "no_selector")
    rest = [c for c in requests.columns if c not in (key, "selector", "type")]
    return requests.join(known, key, "left").select(
        key, *rest, F.coalesce(own, theirs).alias("selector"), kind.alias("type"), error.alias("error")
    )


def verify_selectors(
    requests: DataFrame,
    pages: DataFrame,
    cache: DataFrame | None = None,
    **options,
) -> DataFrame:
    """What every ``(url, selector, type)`` extracts.

    ``(url, selector, type, success, content, word_count, bytes, chars, preview, lines_left, error)``; the
    selector ``body`` means css ``body`` whatever the type. There may be any number of different selectors; one outside the
    grammar fails by itself. A page is taken apart once for all its selectors.
    """
    want = normal_selector(F.col("selector"), F.col("type"))
    asked = requests.select("url", "selector", "type").withColumns({"url_hash": url_hash("url"), "want": want})
    work = asked.groupBy("url_hash").agg(F.max("url").alias("url"), F.collect_set("want").alias("wants"))
    found = find_pages(work, pages, cache).withColumn("missing", F.col("html").isNull())
    converted = convert_wanted(found, ("url_hash",), carry=("missing",), **options)
    converted = converted.withColumn("want", F.struct("selector", "type")).drop("url", "selector", "type")
    out = asked.join(converted, ["url_hash", "want"], "left")
    ok = F.col("content").isNotNull()
    return out.select(
        "url", "selector", "type", ok.alias("success"), "content",
        F.coalesce("word_count", F.lit(0)).cast("bigint").alias("word_count"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.char_length("content"), F.lit(0)).cast("bigint").alias("chars"),
        preview_head("content").alias("preview"), preview_rest("content").alias("lines_left"),
        F.when(F.col("missing"), "render: page not available").when(~ok, F.col("error")).alias("error"),
    )


def selector_coverage(checks: DataFrame) -> DataFrame:
    """Per site and selector: pages checked and hit, words and characters extracted."""
    return checks.groupBy(host("url").alias("site"), "selector").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("success").alias("hits"),
        F.sum("word_count").cast("bigint").alias("words"),
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("chars").cast("bigint").alias("chars"),
    )


def update_selectors(catalogs: DataFrame, checks: DataFrame, key: str = "site") -> DataFrame:
    """Catalogs with the content selector and type of ``checks (key, selector, type, success, checked_at)``, where a
    check succeeded, the latest one deciding; the others stay as they are."""
    found = F.max_by(F.struct("selector", "type"), F.struct("checked_at", "selector", "type"))
    new = checks.where("success").groupBy(key).agg(found.alias("_n"))
    s = F.col("selectors")
    changed = s.withField("content", F.col("_n.selector")).withField("content_type", F.col("_n.type"))
    out = catalogs.join(new, key, "left").withColumn("selectors", F.when(F.col("_n").isNull(), s).otherwise(changed))
    return out.select(*catalogs.columns)

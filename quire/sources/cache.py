"""The page cache: a table of page markup keyed by the hash of the address."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.urls import cache_file, url_hash

SCHEMA = "url_hash string, url string, html string, fetched_at timestamp"
META = "map<string, struct<url:string, file:string, fetched_at:string, status:int>>"


def cache_lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """``items`` with ``html`` and ``from_cache``, a row per item. The stored page decides, not the metadata; entries never expire.

    Where the cache holds an address more than once, the latest page counts, of equally late ones the greatest text.
    """
    order = ["fetched_at", "html"] if "fetched_at" in cache.columns else ["html"]
    stored = cache.groupBy("url_hash").agg(F.max_by("html", F.struct(*order)).alias("html"), F.lit(True).alias("_hit"))
    found = items.withColumn("url_hash", url_hash("url")).join(stored, "url_hash", "left")
    return found.withColumn("from_cache", F.col("_hit").isNotNull()).drop("_hit")


def cache_upsert(cache: DataFrame, new_pages: DataFrame) -> DataFrame:
    """The cache after writing ``new_pages (url, html, fetched_at)``: the latest write of an address stays.

    At equal times a new page beats a stored one.
    """
    new = new_pages.select(url_hash("url").alias("url_hash"), "url", "html", "fetched_at", F.lit(1).alias("turn"))
    old = cache.select("url_hash", "url", "html", "fetched_at", F.lit(0).alias("turn"))
    row = F.struct("url", "html", "fetched_at")
    latest = old.unionByName(new).groupBy("url_hash").agg(
        F.max_by(row, F.struct("fetched_at", "turn", F.md5("html"))).alias("r")
    )
    return latest.select("url_hash", "r.*")


def cache_has(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows of ``urls`` whose address the cache's metadata lists."""
    return urls.join(cache.select("url").distinct(), "url", "left_semi")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).cast("bigint").alias("bytes")
    )


def cache_names(pages: DataFrame) -> DataFrame:
    return pages.select("url", url_hash("url").alias("url_hash"), cache_file("url").alias("file"))


def read_cache_meta(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a metadata document ``(url, file, fetched_at, status)``; none if it is missing or broken."""
    empty = spark.createDataFrame([], "url string, file string, fetched_at string, status int")
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    parsed = texts.select(F.from_json("value", f"entries {META}").alias("meta"))
    rows = parsed.select(F.explode("meta.entries").alias("key", "entry"))
    return rows.select(F.coalesce("entry.url", "key").alias("url"), "entry.file", "entry.fetched_at", "entry.status")

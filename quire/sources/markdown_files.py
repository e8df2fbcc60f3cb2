"""Markdown results as a table or as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import front_matter_source


def write_markdown(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Documents ``(site, output_path, source, content)`` as a Parquet table; one commit for the whole run."""
    documents.select("site", "output_path", "source", "content").write.mode(mode).parquet(path)


def export_markdown(documents: DataFrame) -> None:
    """Documents as single files at ``output_path``, a place that all executors share."""

    def write(rows) -> None:
        import os

        for row in rows:
            os.makedirs(os.path.dirname(row.output_path), exist_ok=True)
            with open(row.output_path, "w", encoding="utf-8", newline="") as f:
                f.write(row.content)

    documents.select("output_path", "content").foreachPartition(write)


def sources_of(documents: DataFrame) -> DataFrame:
    """``(output_path, source)`` of documents whose header names a source."""
    return documents.select("output_path", front_matter_source("content").alias("source")).where(F.col("source").isNotNull())


def read_markdown(spark: SparkSession, path: str, files: bool = False) -> DataFrame:
    """What a run has already written: ``(output_path, source)``.

    The table has the source in a column of its own, so the contents are not read; of single files the header
    is.
    """
    if files:
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
        name = F.regexp_replace("_metadata.file_path", r"\Afile:/*", "/")
        return sources_of(texts.select(name.alias("output_path"), F.col("value").alias("content")))
    return spark.read.parquet(path).select("output_path", "source")

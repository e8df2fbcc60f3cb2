"""Rendered pages: the table every operator starts from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def stream_place(spark: SparkSession, path: str) -> tuple[str, str]:
    """Folder and name pattern to stream a table from that is a folder of part files, or one file."""
    files = spark.read.parquet(path).inputFiles()
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rstrip("/").rpartition("/")[2] == name:
        return folder, name
    return path, "*.parquet"


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Pages as files arrive in a folder."""
    return (
        spark.readStream.schema(SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def render_pages(pending: DataFrame, render: Callable[[str], str]) -> DataFrame:
    """Pages of ``pending (url)`` from a function of the caller: ``(url, html, error)``.

    The function runs on executors, only for addresses that are really pending. A failure becomes an error of
    its row.
    """

    def batches(frames: Iterator) -> Iterator:
        for frame in frames:
            html, error = [], []
            for url in frame["url"]:
                try:
                    html.append(render(url))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    html.append(None)
                    error.append(f"render: {e}")
            yield frame.assign(html=html, error=error)

    return pending.select("url").mapInPandas(batches, "url string, html string, error string")

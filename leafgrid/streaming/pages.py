"""Incremental reading of page drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafgrid.schemas import FILE_PAGE
from leafgrid.sources.pages import page_files
from leafgrid.sources.snapshot import merge_files


def stream_file_pages(
    spark: SparkSession, path: str, multi_line: bool = False
) -> DataFrame:
    """The files of pages as they arrive; same rows as the batch read."""
    return page_files(
        spark.readStream.schema(FILE_PAGE).json(path, multiLine=multi_line)
    )


def append_new_pages(
    files: DataFrame, snapshot: str, checkpoint: str
) -> StreamingQuery:
    """Append every page not read before to a Parquet snapshot, then stop."""
    return (
        files.writeStream.format("parquet")
        .option("path", snapshot)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_new_pages(
    files: DataFrame, snapshot: str, checkpoint: str
) -> StreamingQuery:
    """Merge every page not read before into a snapshot of one row per id, then stop.

    A batch that runs again after a failure merges the same records and so gives
    the same snapshot; see ``leafgrid.sources.snapshot``.
    """
    return (
        files.writeStream.foreachBatch(lambda batch, _: merge_files(batch, snapshot))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

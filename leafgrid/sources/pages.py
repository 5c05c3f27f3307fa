"""File catalog snapshots: pages of nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.schemas import FILE_PAGE


def page_files(pages: DataFrame) -> DataFrame:
    """One row per file of each page; a page without files gives none."""
    return pages.selectExpr("inline(files)")


def read_file_pages(
    spark: SparkSession, path: str, multi_line: bool = False
) -> DataFrame:
    """All files of all pages under ``path``; absent keys are null.

    A line holds a page, so large files are split. ``multi_line`` reads files
    that spread one page over several lines, each whole in one task.
    """
    return page_files(spark.read.schema(FILE_PAGE).json(path, multiLine=multi_line))


def parse_pages(df: DataFrame, page: Column | str) -> DataFrame:
    """Files of pages held as JSON text in a column."""
    parsed = df.select(F.from_json(page, FILE_PAGE).alias("page"))
    return page_files(parsed.select("page.*"))

"""Filters over the file catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.catalog import is_live, sort_struct


def in_corpora(files: DataFrame, corpora: str) -> DataFrame:
    """All files, or for ``user`` only those outside shared drives."""
    if corpora == "user":
        return files.filter(F.col("driveId").isNull())
    if corpora != "allDrives":
        raise ValueError(f"corpora must be 'allDrives' or 'user', not {corpora!r}")
    return files


def child_edges(files: DataFrame) -> DataFrame:
    """Each live file once for every parent it has.

    A table that has a ``parent`` column is taken as such edges already; see
    ``leafgrid.sources.edges``.
    """
    if "parent" in files.columns:
        return files
    parents = F.explode(F.array_distinct("parents"))
    return files.filter(is_live()).withColumn("parent", parents)


def list_children(
    files: DataFrame, folder_id: str, corpora: str = "allDrives"
) -> DataFrame:
    """Live direct children of a folder, in no order; see ``in_order``."""
    if "parent" in files.columns:
        inside = F.col("parent") == folder_id
    else:
        inside = F.array_contains("parents", F.lit(folder_id))
    return in_corpora(files, corpora).filter(is_live() & inside)


def shared_items(files: DataFrame) -> DataFrame:
    shared = F.col("sharedWithMeTime").isNotNull()
    return in_corpora(files, "user").filter(shared & is_live())


def shared_with_me(files: DataFrame, name: str | None = None) -> DataFrame:
    """Live items shared with the user, optionally of one name in any case."""
    items = shared_items(files)
    if name:
        items = items.filter(F.lower("name") == F.lower(F.lit(name)))
    return items


def in_order(files: DataFrame) -> DataFrame:
    """Folders first, then by name in any case, for those who print or write rows."""
    return files.orderBy(sort_struct())


def get_metadata(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Id, name and MIME type of the files whose ``id`` is in ``ids``."""
    wanted = ids.select("id").distinct()
    return files.select("id", "name", "mimeType").join(wanted, "id")

"""Listings that start from a path, an id or the shared items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.operators.children import shared_with_me
from leafgrid.operators.resolve import resolve_paths, resolve_shared_paths
from leafgrid.operators.walk import listing, shared_listing


def list_path(
    files: DataFrame,
    drives: DataFrame,
    path: str,
    depth: int | None = 1,
) -> DataFrame:
    """Listing of the folder a drive path leads to."""
    found = resolve_paths(_request(files, path), files, drives)
    return listing(files, _folder_id(found, path), depth)


def list_shared(
    files: DataFrame, path: str | None = None, depth: int | None = 1
) -> DataFrame:
    """Listing of all shared items, or of the shared folder at ``path``."""
    if path is None:
        return shared_listing(shared_with_me(files))
    found = resolve_shared_paths(_request(files, path), files)
    return listing(files, _folder_id(found, path), depth)


def _request(files: DataFrame, path: str) -> DataFrame:
    return files.sparkSession.range(1).select(F.lit(path).alias("path"))


def _folder_id(found: DataFrame, path: str) -> str:
    row = found.first()
    if row["status"] != "ok":
        raise ValueError(
            f"{path!r}: {row['kind']} {row['segment']!r} {row['status']}"
        )
    return row["id"]

"""The folder walk and the listing made from it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch, skew
from leafgrid.functions.catalog import (
    file_type,
    file_url,
    is_folder,
    modified_date,
    owner_email,
    shared_by,
    sort_struct,
)
from leafgrid.operators.children import child_edges

FOLDER_COLUMNS = (
    "folder_id STRING, ancestors ARRAY<STRING>, "
    "sort_key ARRAY<STRUCT<is_file: BOOLEAN, lname: STRING, id: STRING>>"
)


def walk_tree(files: DataFrame, root_id: str, depth: int | None = None) -> DataFrame:
    """Every live descendant of a folder, one row per path to it.

    Adds to the file columns: ``ancestors`` (raw folder names below the root),
    ``depth`` (their number), ``descended`` (folders the walk went into) and
    ``sort_key``. Ordering by ``sort_key`` gives the depth-first order with
    folders before files. ``depth=1`` lists the folder only, None has no limit.

    Only folders take part in the level-by-level descent. Files, the bulk of a
    catalog, are joined to their folder once at the end. A folder that is its
    own ancestor is not entered again.
    """
    edges = child_edges(files)
    folders, size = walked_folders(edges, root_id, depth)
    folders = skew.sized(folders, size)
    level = F.size("ancestors")
    within = F.lit(True) if depth is None else level + 1 < depth
    return (
        edges.join(folders, F.col("parent") == F.col("folder_id"))
        .filter(~is_folder() | _is_new(root_id))
        .select(
            *[c for c in files.columns if c != "parent"],
            "ancestors",
            level.alias("depth"),
            (is_folder() & within).alias("descended"),
            _extended_key().alias("sort_key"),
        )
    )


def walked_folders(
    edges: DataFrame,
    root_id: str,
    depth: int | None = None,
    hot_rows: int = skew.HOT_ROWS,
) -> tuple[DataFrame, int]:
    """The root and every folder the walk descends into, and their size in bytes.

    The catalog is read once, for its folder edges. More than ``hot_rows`` of
    them are shuffled once, by parent, and kept for all levels; each level then
    shuffles only the folders the level before has found. A parent with very
    many subfolders is spread over several partitions. Each level is written as
    a table and measured, so that a small one is broadcast.
    """
    spark = edges.sparkSession
    root = spark.range(1).select(
        F.lit(root_id).alias("folder_id"),
        F.expr("CAST(array() AS ARRAY<STRING>)").alias("ancestors"),
        F.expr(
            "CAST(array() AS ARRAY<STRUCT<is_file: BOOLEAN, lname: STRING, id: STRING>>)"
        ).alias("sort_key"),
    )
    if depth is not None and depth <= 1:
        return root, 0

    rows = F.count(F.lit(1))
    size = F.sum(
        F.octet_length(F.array_join("ancestors", ""))
        + F.octet_length(F.array_join("sort_key.id", ""))
        + F.octet_length(F.array_join("sort_key.lname", ""))
        + F.size("sort_key") * 48
        + 100
    )
    below = edges.filter(is_folder()).select("parent", "id", "name", "mimeType")
    keys, hot = ["parent"], None
    if depth != 2:  # more than one level: the edges are used again
        below, seen = scratch.measure(below, "folder-edges", rows=rows)
        if seen["rows"] > hot_rows:
            keys = ["parent", "slot"]
            hot = scratch.store(skew.hot_keys(below, "parent", hot_rows), "hot")
            below = (
                skew.spread_many(below, "parent", "id", hot)
                .repartition(skew.shuffle_partitions(edges), *keys)
                .persist(StorageLevel.DISK_ONLY)
            )

    path = scratch.new_path(spark, "folders")
    found, seen, total = root, {"size": 0}, 0
    level = 0
    while depth is None or level + 1 < depth:
        level += 1
        frontier = found.withColumnRenamed("folder_id", "parent")
        if hot is not None:
            frontier = skew.spread_one(frontier, "parent", hot)
        entered = (
            below.join(skew.sized(frontier, seen["size"]), keys)
            .filter(_is_new(root_id))
            .select(
                F.col("id").alias("folder_id"),
                F.concat("ancestors", F.array("name")).alias("ancestors"),
                _extended_key().alias("sort_key"),
            )
        )
        found, seen = scratch.measure(
            entered, "level", f"{path}/level={level}", rows=rows, size=size
        )
        if not seen["rows"]:
            break
        total += seen["size"]
    if hot is not None:
        below.unpersist()

    levels = spark.read.schema(FOLDER_COLUMNS).parquet(path).drop("level")
    return root.unionByName(levels), total


def listing(files: DataFrame, root_id: str, depth: int | None = None) -> DataFrame:
    """Listing rows of everything below a folder, with their ``sort_key``."""
    return listing_rows(walk_tree(files, root_id, depth))


def listing_rows(walk: DataFrame) -> DataFrame:
    prefix = F.array_join(
        F.transform("ancestors", lambda name: F.concat(name, F.lit("/"))), ""
    )
    return walk.select(*_entry(prefix, F.col("depth")), "sort_key")


def shared_listing(shared: DataFrame) -> DataFrame:
    """Listing rows of shared items: no folder above them, depth 0."""
    return shared.select(
        *_entry(F.lit(""), F.lit(0)), F.array(sort_struct()).alias("sort_key")
    )


def _entry(prefix: Column, depth: Column) -> list[Column]:
    slash = F.when(is_folder(), F.lit("/")).otherwise(F.lit(""))
    return [
        file_url().alias("url"),
        F.concat(prefix, F.col("name"), slash).alias("path"),
        F.col("name"),
        file_type().alias("file_type"),
        modified_date().alias("modified"),
        owner_email().alias("owner"),
        shared_by().alias("shared_by"),
        depth.alias("depth"),
    ]


def _extended_key() -> Column:
    return F.concat("sort_key", F.array(sort_struct()))


def _is_new(root_id: str) -> Column:
    """True unless the row's id is already on the path from the root."""
    on_path = F.exists("sort_key", lambda step: step["id"] == F.col("id"))
    return (F.col("id") != root_id) & ~on_path

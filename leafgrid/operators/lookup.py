"""Drive lookup by name and by path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.skew import sized


def drive_index(drives: DataFrame) -> DataFrame:
    """One drive per case-insensitive name: the first in catalog order."""
    return drives.groupBy(F.lower("name").alias("drive_key")).agg(
        F.min_by(F.struct("id", "type", "name", "url"), "ord").alias("drive")
    )


def stored_index(drives: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """The stored drive index, its size, and the numbers of name parts that occur."""
    index, seen = scratch.measure(
        drive_index(drives),
        "drives",
        size=F.sum(F.octet_length(F.to_json("drive")) + F.octet_length("drive_key")),
        lengths=F.collect_set(F.size(F.split("drive_key", "/"))),
    )
    return index, seen["size"] or 0, sorted(seen["lengths"] or [])


def find_drive(names: DataFrame, drives: DataFrame) -> DataFrame:
    """Adds the drive called ``name`` to each row; nulls where there is none.

    The index is stored and measured. Beyond a broadcast it is sort-merged, where
    a name that very many rows ask for can be split.
    """
    index, size, _ = stored_index(drives)
    found = names.join(
        sized(index, size), F.lower(names["name"]) == F.col("drive_key"), "left"
    )
    return found.select(
        *[names[c] for c in names.columns],
        F.col("drive.id").alias("drive_id"),
        F.col("drive.type").alias("drive_type"),
        F.col("drive.name").alias("drive_name"),
        F.col("drive.url").alias("drive_url"),
    )


def path_parts(path: str = "path"):
    return F.split(F.regexp_replace(path, r"^/+|/+\z", ""), "/")


def match_drive_prefix(paths: DataFrame, drives: DataFrame) -> DataFrame:
    """Longest leading part of each distinct ``path`` that names a drive.

    Drive names may hold slashes. ``rest`` are the segments after the drive;
    ``drive_id`` is null where no prefix fits.
    """
    distinct = paths.select("path").distinct().withColumn("parts", path_parts())
    return with_drive(distinct, drives).select(
        "path",
        F.col("drive.id").alias("drive_id"),
        F.col("drive.name").alias("drive_name"),
        "rest",
    )


def with_drive(paths: DataFrame, drives: DataFrame) -> DataFrame:
    """Adds ``drive`` and ``rest`` to rows with path ``parts``, without grouping.

    Of each path only the prefixes are made that have as many parts as some drive
    name, in most catalogs one. Each such number is one join, longer names first;
    a path that has its drive asks for no more.
    """
    index, size, lengths = stored_index(drives)
    index = sized(index, size)
    found = paths.withColumns(
        {
            "drive": F.lit(None).cast(index.schema["drive"].dataType),
            "rest": F.lit(None).cast("array<string>"),
        }
    )
    for n in reversed(lengths):
        asks = F.col("drive.id").isNull() & (F.size("parts") >= n)
        # Paths that do not ask are spread by their own text, and match nothing.
        key = F.when(asks, _prefix(n)).otherwise(F.concat(F.lit("/"), _prefix(n)))
        joined = found.withColumn("prefix_key", key).join(
            index.select("drive_key", F.col("drive").alias("named")),
            F.col("prefix_key") == F.col("drive_key"),
            "left",
        )
        fits = F.col("named.id").isNotNull()
        found = joined.select(
            *paths.columns,
            F.when(fits, F.col("named")).otherwise(F.col("drive")).alias("drive"),
            F.when(fits, F.slice("parts", F.lit(n + 1), F.size("parts")))
            .otherwise(F.col("rest"))
            .alias("rest"),
        )
    return found


def _prefix(n: int) -> Column:
    return F.lower(F.array_join(F.slice("parts", 1, n), "/"))

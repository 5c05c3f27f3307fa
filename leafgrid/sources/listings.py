"""Listing sinks: CSV and a linked folder map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch


def listing_csv(listing: DataFrame, *keep: str) -> DataFrame:
    """The seven CSV columns, after ``keep``; a path loses all its trailing slashes."""
    return listing.select(
        *keep,
        F.regexp_replace("path", r"/+\z", "").alias("path"),
        "name",
        F.col("file_type").alias("type"),
        "modified",
        "owner",
        "shared_by",
        "url",
    )


def write_listing_csv(listing: DataFrame, path: str) -> None:
    """Write a header and the CSV columns in walk order.

    The header is a row of the first part only, so that the parts joined by name
    are one CSV file.
    """
    body = listing_csv(listing)
    names = body.columns
    title = listing.sparkSession.createDataFrame([tuple(names)], body.schema)
    if "sort_key" in listing.columns:
        # A null key is first in ascending order.
        keyed = listing_csv(listing, "sort_key")
        title = title.withColumn("sort_key", F.lit(None).cast(keyed.schema["sort_key"].dataType))
        body = title.unionByName(keyed).orderBy("sort_key").select(*names)
    else:
        body = title.coalesce(1).union(body)
    body.write.mode("overwrite").csv(
        path,
        lineSep="\r\n",
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def folder_map(listing: DataFrame) -> DataFrame:
    """One nested bullet per entry, linked where it has a url."""
    bullet = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "))
    link = F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")"))
    line = F.concat(bullet, F.when(F.col("url") != "", link).otherwise(F.col("name")))
    keys = [c for c in listing.columns if c == "sort_key"]
    return listing.select(*keys, line.alias("line"))


def write_folder_map(listing: DataFrame, path: str) -> None:
    """Write the bullets in walk order; the parts follow one another by name."""
    folder_map(_in_order(listing)).select("line").write.mode("overwrite").text(path)


# How each extension of a save path is written.
WRITERS = {".md": write_folder_map, ".csv": write_listing_csv}


def save_listing(listing: DataFrame, paths: list[str]) -> bool:
    """Write one listing to several paths from one traversal.

    The rows are stored once; every writer reads that table, and it is gone when
    all are done. The extension picks the format. False, and nothing written, when
    the listing has no rows.
    """
    writers = []
    for path in paths:
        found = [w for extension, w in WRITERS.items() if path.endswith(extension)]
        if not found:
            raise ValueError(f"cannot tell the format of {path!r}: use .md or .csv")
        writers.append((found[0], path))

    with scratch.scope(listing.sparkSession):
        kept, seen = scratch.measure(listing, "listing", rows=F.count(F.lit(1)))
        if seen["rows"]:
            for write, path in writers:
                write(kept, path)
    return bool(seen["rows"])


def _in_order(listing: DataFrame) -> DataFrame:
    return listing.orderBy("sort_key") if "sort_key" in listing.columns else listing

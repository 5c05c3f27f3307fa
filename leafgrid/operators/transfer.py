"""What a transfer of a folder would do: classes, totals, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.catalog import (
    EXPORT_EXTENSIONS,
    EXPORT_MIME_TYPES,
    extract_id,
    is_folder,
    is_native,
    lookup,
    size_in_bytes,
)
from leafgrid.functions.names import clean_path, safe_filename, suffix


def export_extension() -> Column:
    return lookup(EXPORT_EXTENSIONS, F.col("mimeType"))


def disposition() -> Column:
    """``binary``, ``export`` (native with an export form) or ``skip``."""
    return (
        F.when(~is_native(), F.lit("binary"))
        .when(export_extension().isNotNull(), F.lit("export"))
        .otherwise(F.lit("skip"))
    )


def classify(files: DataFrame) -> DataFrame:
    """Adds ``disposition`` to every file that is not a folder."""
    return files.filter(~is_folder()).withColumn("disposition", disposition())


def summarize(walk: DataFrame) -> DataFrame:
    """Six totals of a walk in one pass; zeros for an empty one."""
    return totals(walk.select(_action().alias("action"), _bytes().alias("bytes")))


def totals(manifest: DataFrame) -> DataFrame:
    """The six totals, from the actions and sizes of a manifest."""

    def entries(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    return manifest.agg(
        entries("binary").alias("binary_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("binary_bytes"),
        entries("export").alias("auto_export"),
        entries("skip_native").alias("skipped_natives"),
        entries("mkdir").alias("subfolders"),
        entries("skip_depth").alias("skipped_subfolders"),
    )


def transfer_manifest(walk: DataFrame, out_dir: str) -> DataFrame:
    """One row per walked entry: what happens to it, where, under which name.

    ``action`` is ``mkdir``, ``skip_depth``, ``skip_native``, ``export`` or
    ``binary``. ``dir`` is the parent directory, ``base`` the wanted name,
    ``bytes`` the size of a binary file.
    """
    extension = F.coalesce(export_extension(), F.lit(""))
    return walk.select(
        "id",
        _action().alias("action"),
        _directory(_clean(out_dir)).alias("dir"),
        F.concat(safe_filename(F.col("name")), extension).alias("base"),
        _bytes().alias("bytes"),
        "depth",
        "sort_key",
    )


def single_file_walk(file: DataFrame) -> DataFrame:
    """A file that is downloaded by itself, as a walk of one row."""
    return (
        file.withColumn("ancestors", F.expr("CAST(array() AS ARRAY<STRING>)"))
        .withColumn("depth", F.lit(0))
        .withColumn("descended", F.lit(False))
        .withColumn(
            "sort_key",
            F.array(
                F.struct(
                    F.lit(True).alias("is_file"),
                    F.lower("name").alias("lname"),
                    F.col("id").alias("id"),
                )
            ),
        )
    )


def entry_path(directory: Column, name: Column) -> Column:
    """``directory/name`` as a path reads: nothing in front for ``.``."""
    return (
        F.when(directory == ".", name)
        .when(directory == "/", F.concat(F.lit("/"), name))
        .otherwise(F.concat(directory, F.lit("/"), name))
    )


def path_conflicts(
    targets: DataFrame,
    existing: DataFrame | None = None,
    out_dir: str | None = None,
) -> DataFrame:
    """Directories that cannot be made because a file has their path.

    ``targets`` is a manifest with its ``target`` paths. The file either exists
    already (``existing``: ``path``, ``is_dir``) or comes earlier in the walk.
    Folders of the same path merge without a conflict; a plan without rows here
    can be carried out. ``out_dir`` is the output folder, which the targets name
    as well unless the walk found nothing.
    """
    made = (
        targets.filter(F.col("action") == "mkdir")
        .groupBy(entry_path(F.col("dir"), F.col("base")).alias("path"))
        .agg(F.max("sort_key").alias("folder_key"))
        .withColumn("spot", F.xxhash64("path"))
    )
    taken = targets.filter(F.col("action").isin("binary", "export")).select(
        F.xxhash64("target").alias("spot"),
        F.col("target").alias("path"),
        F.col("sort_key").alias("file_key"),
    )
    # Sorted by a hash first: paths share long beginnings.
    earlier = (
        made.join(taken, ["spot", "path"])
        .filter(F.col("file_key") < F.col("folder_key"))
        .select("path")
    )
    if existing is not None:
        top = targets.filter(F.col("depth") == 0).select(F.col("dir").alias("path"))
        parents = top.distinct().union(made.select("path"))
        if out_dir is not None:
            given = targets.sparkSession.range(1).select(F.lit(out_dir).alias("path"))
            parents = parents.union(given.select(clean_path("path").alias("path")))
        files = existing.filter(~F.col("is_dir")).select(clean_path("path").alias("path"))
        earlier = earlier.union(parents.join(files, "path", "left_semi"))
    reason = F.lit("a file with that name exists")
    return earlier.distinct().withColumn("error", reason)


def export_plan(requests: DataFrame) -> DataFrame:
    """The file id and export MIME type of each (``source``, ``output``) pair."""
    extension = F.lower(suffix(F.col("output")))
    planned = requests.withColumn("id", extract_id(F.col("source"))).withColumn(
        "mime", lookup(EXPORT_MIME_TYPES, extension)
    )
    supported = ", ".join(sorted(EXPORT_MIME_TYPES))
    status = (
        F.when(F.col("id").isNull(), F.lit("no id in url"))
        .when(F.col("mime").isNull(), F.lit(f"unsupported extension, use {supported}"))
        .otherwise(F.lit("ok"))
    )
    return planned.withColumn("status", status)


def _clean(out_dir: str) -> str:
    parts = [p for p in out_dir.split("/") if p not in ("", ".")]
    root = "/" if out_dir.startswith("/") else ""
    return root + "/".join(parts) or "."


def _directory(out_dir: str) -> Column:
    below = F.array_join(F.transform("ancestors", safe_filename), "/")
    start = {".": "", "/": "/"}.get(out_dir, out_dir + "/")
    return F.when(F.size("ancestors") == 0, F.lit(out_dir)).otherwise(
        F.concat(F.lit(start), below)
    )


def _action() -> Column:
    kind = disposition()
    return (
        F.when(is_folder() & F.col("descended"), F.lit("mkdir"))
        .when(is_folder(), F.lit("skip_depth"))
        .when(kind == "skip", F.lit("skip_native"))
        .otherwise(kind)
    )


def _bytes() -> Column:
    return F.when(~is_native(), size_in_bytes()).otherwise(F.lit(0))

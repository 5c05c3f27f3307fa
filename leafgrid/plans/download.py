"""The plan of a whole folder transfer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.functions.catalog import is_folder
from leafgrid.operators.targets import allocate_targets
from leafgrid.operators.transfer import (
    path_conflicts,
    single_file_walk,
    totals,
    transfer_manifest,
)
from leafgrid.operators.resolve import resolve_sources
from leafgrid.operators.walk import walk_tree


class DownloadPlan(NamedTuple):
    """``summary`` is one row; ``manifest`` has the target paths."""

    summary: DataFrame
    manifest: DataFrame
    conflicts: DataFrame


def plan_download(
    files: DataFrame,
    source_id: str,
    out_dir: str = ".",
    depth: int | None = None,
    existing: DataFrame | None = None,
) -> DownloadPlan:
    """Plan the transfer of a folder, or of one file, into ``out_dir``.

    The tree is walked once, into a stored manifest; the totals, the targets and
    the conflicts all come from its rows. With nothing to transfer the manifest
    is empty.
    """
    source = files.filter(F.col("id") == source_id)
    alone = source.filter(~is_folder())
    single = not alone.isEmpty()
    walk = single_file_walk(alone) if single else walk_tree(files, source_id, depth)
    manifest = scratch.store(transfer_manifest(walk, out_dir), "manifest")
    summary = scratch.store(totals(manifest), "summary")
    planned = summary.first()
    if not single and planned["binary_files"] + planned["auto_export"] == 0:
        manifest = manifest.filter(F.lit(False))
    targets = scratch.store(allocate_targets(manifest, existing), "targets")
    return DownloadPlan(summary, targets, path_conflicts(targets, existing))


def plan_source(
    files: DataFrame,
    drives: DataFrame,
    source: str,
    out_dir: str = ".",
    depth: int | None = None,
    existing: DataFrame | None = None,
) -> DownloadPlan:
    """``plan_download`` for a link or a drive path; a path may name a file."""
    request = files.sparkSession.range(1).select(F.lit(source).alias("source"))
    found = resolve_sources(request, "download", files, drives).first()
    if found["status"] != "ok":
        raise ValueError(f"{source!r}: {found['status']}")
    return plan_download(files, found["id"], out_dir, depth, existing)

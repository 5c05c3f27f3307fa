"""A catalog snapshot kept up to date from drops of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid import scratch, skew
from leafgrid.schemas import FILE
from leafgrid.sources.versions import current_version, save_version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot, one row per id; empty before the first drop."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], FILE)
    return spark.read.schema(FILE).parquet(version)


def latest_records(files: DataFrame, turn: str | None = None) -> DataFrame:
    """One record per id: the last modified, then of the last ``turn``.

    Times compare as text, as the service writes them; no time is the earliest.
    Records that still tie are ordered by their content, so reruns agree. An id
    is what names a file, so records without one are left out. Partial maxima are
    taken before the shuffle: many records of one id never meet in one task.
    """
    record = F.struct(*FILE.names)
    order = F.struct(
        "modifiedTime", F.col(turn) if turn else F.lit(0), F.to_json(record)
    )
    return (
        files.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("key"))
        .agg(F.max_by(record, order).alias("record"))
        .select("record.*")
    )


def merge_files(new: DataFrame, path: str) -> None:
    """Put ``new`` records into the snapshot at ``path``: a new version of it.

    A record replaces the one of its id unless that was modified later, so a drop
    that comes twice, or late, changes nothing. Only the records of ids in the
    drop are grouped; the rest of the snapshot is passed on by an anti-join, which
    needs no shuffle while the ids of the drop measure small. Their size is that of
    the ids as text: their files, compressed, tell too little to broadcast by.
    """
    spark = new.sparkSession
    with scratch.scope(spark):
        fresh, seen = scratch.measure(
            latest_records(new), "fresh", size=F.sum(F.octet_length("id") + 64)
        )
        ids = skew.sized(fresh.select("id"), seen["size"])
        old = read_snapshot(spark, path)
        known = old.join(ids, "id", "left_semi").withColumn("turn", F.lit(0))
        newest = latest_records(
            known.unionByName(fresh.withColumn("turn", F.lit(1))), "turn"
        )
        rest = old.join(ids, "id", "left_anti")
        save_version(rest.unionByName(newest), path, "parquet")

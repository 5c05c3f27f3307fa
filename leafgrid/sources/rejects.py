"""Catalog records whose time or size cannot be read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.functions.catalog import is_malformed_size, is_malformed_time


class Split(NamedTuple):
    """``readable`` has the records' columns; ``rejects`` one row per bad field:
    ``id``, ``field``, ``value``, ``reason``."""

    readable: DataFrame
    rejects: DataFrame


def split_rejects(files: DataFrame) -> Split:
    """Set records with an unreadable ``modifiedTime`` or ``size`` apart.

    One pass writes both kinds, each to a partition of its own; a record is in
    exactly one of them. Null and empty fields are absent, not unreadable. A
    rejected size is one that ``size_in_bytes`` counts as nothing.
    """
    checks = [
        ("modifiedTime", is_malformed_time(), "no date"),
        ("size", is_malformed_size(), "no number of bytes"),
    ]
    found = F.array(
        *[
            F.when(
                bad,
                F.struct(
                    F.lit(field).alias("field"),
                    F.col(field).alias("value"),
                    F.lit(reason).alias("reason"),
                ),
            )
            for field, bad, reason in checks
        ]
    )
    spark = files.sparkSession
    marked = files.withColumn("faults", F.array_compact(found)).withColumn(
        "rejected", F.size("faults") > 0
    )
    path = scratch.new_path(spark, "split")
    marked.write.partitionBy("rejected").parquet(path)
    kept = spark.read.schema(marked.schema).parquet(path)
    return Split(
        kept.filter(~F.col("rejected")).select(*files.columns),
        kept.filter("rejected").select("id", F.explode("faults").alias("f")).select("id", "f.*"),
    )

"""A catalog laid out by parent folder.

A filter on an array of parents cannot be pushed into a scan. Here each live file
is stored once per parent, sorted by it, so that listing or walking a folder
reads only the row groups whose parent range covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafgrid.operators.children import child_edges


def write_edges(files: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the parent edges of a catalog, range-partitioned by (parent, id).

    The id keeps a folder with very many children from becoming one partition.
    """
    columns = ["parent", "id"]
    counts = [partitions] if partitions else []
    child_edges(files).repartitionByRange(*counts, *columns).sortWithinPartitions(
        *columns
    ).write.mode("overwrite").parquet(path)


def read_edges(spark, path: str) -> DataFrame:
    """Edges for the tree and path operators, in place of the catalog."""
    return spark.read.parquet(path)

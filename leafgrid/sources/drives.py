"""The drive catalog: build, save, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions.catalog import FOLDER_URL, MY_DRIVE_URL
from leafgrid.schemas import DRIVE_CATALOG
from leafgrid.sources.versions import current_version, save_version


def read_drives(root: DataFrame, shared: DataFrame) -> DataFrame:
    """The personal drive first, then every shared drive in its own order.

    ``root`` has the personal drive's ``id``; ``shared`` has ``id``, ``name`` and
    an optional ``ord``. Without ``ord`` the order of the input rows is kept.
    """
    order = (
        F.col("ord") if "ord" in shared.columns else F.monotonically_increasing_id()
    )
    personal = root.select(
        "id",
        F.lit("personal").alias("type"),
        F.lit("My Drive").alias("name"),
        F.lit(MY_DRIVE_URL).alias("url"),
        F.lit(0).cast("long").alias("ord"),
    )
    others = shared.select(
        "id",
        F.lit("shared").alias("type"),
        "name",
        F.concat(F.lit(FOLDER_URL), F.col("id")).alias("url"),
        (order + 1).cast("long").alias("ord"),
    )
    return personal.unionByName(others)


def save_drives(drives: DataFrame, path: str) -> None:
    """Write the catalog as JSON, one drive per line, in place of the one before.

    Readers find the whole old catalog or the whole new one; a save that fails
    leaves the old one.
    """
    save_version(drives.select(*DRIVE_CATALOG.names), path, "json")


def load_drives(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved catalog; a path that does not exist is an empty catalog."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], DRIVE_CATALOG)
    return spark.read.schema(DRIVE_CATALOG).json(version)

"""An inventory of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.catalog import extract_id, strip_url_suffix


def link_inventory(links: DataFrame) -> DataFrame:
    """Each id that ``link`` rows point to, how often, and one canonical url.

    Links without an id are kept, one row per canonical url, with status
    ``no_id``.
    """
    read = links.select(
        extract_id(F.col("link")).alias("id"),
        strip_url_suffix(F.col("link")).alias("url"),
    ).withColumn("stray", F.when(F.col("id").isNull(), F.col("url")))
    return (
        read.groupBy("id", "stray")
        .agg(F.count(F.lit(1)).alias("n_links"), F.min("url").alias("url"))
        .select(
            "id",
            "url",
            "n_links",
            F.when(F.col("id").isNull(), "no_id").otherwise("ok").alias("status"),
        )
    )

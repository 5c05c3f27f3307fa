"""Session defaults for the jobs in this package."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(
    app: str = "leafgrid",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC dates.

    Every job also runs on a session built elsewhere; nothing here is required
    for right results, only for good plans.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key's join even where that costs one more shuffle later.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Tables written between the stages of one job.

A stage result is written to the shared folder named by ``spark.checkpoint.dir``
and read back. That cuts the lineage, survives lost executors, and gives
Catalyst the true size of the result, so it broadcasts a side only when the
files on disk are below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folder: str | None = None
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def folder(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="leafgrid-")
    return _local_folder


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored, once its results are used."""
    _delete(spark, f"{folder(spark)}/{spark.sparkContext.applicationId}")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Own the tables that are stored inside, and delete them on leaving.

    For jobs that write their result: it must be written before the scope ends. A
    scope inside another belongs to it.
    """
    path = new_path(spark, "scope")
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    home = _scope.get() or f"{folder(spark)}/{spark.sparkContext.applicationId}"
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measure(df: DataFrame, name: str, path: str | None = None, **metrics: Column):
    """Like ``store``, with aggregates of the rows taken while they are written.

    Gives the table read back and the aggregates by name, without a second job.
    A task run twice may be counted twice, so a sum here is an upper bound: use
    it for "any" and "at most", never as a result.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get

"""Tables that are replaced as a whole, without a moment in which they are half there.

Every version has a folder of its own. When it is complete an empty file of the
same name is made in ``_versions``; the greatest name is the current version.
Making an empty file is atomic on every file system, so a reader finds the version
before or the one after, and a save that fails leaves the old one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKS = "_versions"
# The version before the current one stays, for those who are still reading it.
KEPT = 2


def save_version(df: DataFrame, path: str, fmt: str) -> str:
    """Write ``df`` as the new version of the table at ``path``; gives its folder.

    ``df`` may read the current version. Of two saves at once the one with the
    greater name is current in the end; neither is half there.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    number = int(known[-1].split("-")[0]) + 1 if known else 1
    # A fixed width, so that names order as numbers do.
    name = f"{number:012d}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    try:
        df.write.format(fmt).save(f"{path}/{name}")
    except Exception:
        fs.delete(at(name), True)
        raise
    fs.create(at(f"{MARKS}/{name}"), False).close()
    for old in (known + [name])[:-KEPT]:
        fs.delete(at(f"{MARKS}/{old}"), False)
        fs.delete(at(old), True)
    return f"{path}/{name}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, None if nothing was ever saved."""
    known = _versions(spark, path)
    return f"{path}/{known[-1]}" if known else None


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file_system(spark, path)
    if not fs.exists(at(MARKS)):
        return []
    return sorted(mark.getPath().getName() for mark in fs.listStatus(at(MARKS)))


def _file_system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda below: make(f"{path}/{below}")

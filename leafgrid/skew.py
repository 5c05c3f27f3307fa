"""Work on groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid import scratch

# Rows of one key that one task may sort or hold. A larger group is spread.
HOT_ROWS = 1_000_000


# A side of a join is broadcast only when its rows hold at most this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def sized(df: DataFrame, size: int | None) -> DataFrame:
    """A join side of a measured size: broadcast if small, else sort-merged.

    The size of compressed files says little about rows of nested arrays, so the
    measured one decides, not the automatic threshold.
    """
    if (size or 0) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("merge")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of slots to use.

    At most ``rows / hot_rows`` keys qualify, so the result is small by rule.
    The count is combined map-side; only the key column is read.
    """
    n = F.count(F.lit(1))
    return (
        df.groupBy(key)
        .agg(n.alias("rows"))
        .filter(F.col("rows") > hot_rows)
        .select(key, F.ceil(F.col("rows") / hot_rows).cast("int").alias("slots"))
    )


def spread_many(df: DataFrame, key: str, row_id: str, hot: DataFrame) -> DataFrame:
    """Give each row of the big side a ``slot``; hot keys use several."""
    slot = F.pmod(F.xxhash64(row_id), F.col("slots")).cast("int")
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("slot", F.coalesce(slot, F.lit(0)))
        .drop("slots")
    )


def spread_one(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat each row of the other side once for every slot of its key."""
    last = F.coalesce(F.col("slots"), F.lit(1)) - 1
    return (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), last)))
        .drop("slots")
    )


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    spread: bool,
    rows: int | None = None,
    rows_per_part: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    With ``spread`` false this is one window per group. With ``spread`` true no
    task holds a whole group: rows are range-partitioned on (keys, order), each
    partition adds up its own part of a group, and the sum of the earlier
    partitions is added. A partition can continue at most one group, so there
    are never more carried sums than partitions, and those are broadcast.
    ``rows``, if known, adds partitions beyond the session's number.
    """
    zero = F.lit(0).cast("long")
    df = df.withColumn(out, value.cast("long"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    if not spread:
        w = before.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.coalesce(F.sum(out).over(w), zero))

    parts = max(shuffle_partitions(df), -(-(rows or 0) // rows_per_part))
    ranged = scratch.store(
        df.repartitionByRange(parts, *keys, *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranged",
    )
    earlier = before.partitionBy(*keys).orderBy("_part")
    carried = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(out).alias("_total"))
        .withColumn("_carry", F.sum("_total").over(earlier))
        .filter(F.col("_carry").isNotNull())
        .drop("_total")
    )
    w = before.partitionBy(*keys, "_part").orderBy(*order)
    # Null keys are a group like any other, so they have to meet their carry, too.
    meets = F.col("_part") == F.col("_of_part")
    for n, key in enumerate(keys):
        carried = carried.withColumnRenamed(key, f"_key{n}")
        meets = meets & F.col(key).eqNullSafe(F.col(f"_key{n}"))
    return (
        ranged.withColumn(out, F.coalesce(F.sum(out).over(w), zero))
        .join(F.broadcast(carried.withColumnRenamed("_part", "_of_part")), meets, "left")
        .withColumn(out, F.col(out) + F.coalesce(F.col("_carry"), zero))
        .drop("_part", "_carry", "_of_part", *[f"_key{n}" for n in range(len(keys))])
    )

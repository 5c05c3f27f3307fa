"""Collision-free target paths for the files of a transfer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafgrid import scratch
from leafgrid.functions.names import (
    clean_path, copy_family, copy_origins, numbered, stem, suffix,
)
from leafgrid.operators.transfer import entry_path
from leafgrid.skew import BROADCAST_BYTES, HOT_ROWS, prefix_sum, sized

GROUP = ["dir", "base"]
FAMILY = ["dir", "family"]
# A family behind the hash that orders it.
SPOT = ["spot", *FAMILY]
BEFORE_THE_WALK = "CAST(array() AS ARRAY<STRUCT<is_file: BOOLEAN, lname: STRING, id: STRING>>)"


def allocate_targets(
    manifest: DataFrame, existing: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds the ``target`` path of every file in the manifest; null for the rest.

    A file gets its ``base`` name if that is free at its turn in the walk, else
    ``stem (n).ext`` with the smallest free n. Folders and ``existing`` paths
    take names too. Only names of one family (see ``copy_family``) can meet:

    * a family of different names, none taken: every file keeps its name;
    * a family of one repeated name: n is the file's rank in its directory;
    * any other family is gone through once, in walk order, see ``_first_free``.

    A family of more than ``hot_rows`` names is held by no task: its ranks are
    prefix sums, and if it is mixed it is settled in rounds, see ``_settle``.

    Most files share their family with nobody. They are set apart by counting
    64-bit hashes of (directory, family), a small fraction of the paths; only
    the rest is grouped by name. The hashes lead all sorting, too: paths share
    long beginnings. The manifest is read several times: pass one that is stored.
    """
    files = _with_family(manifest.filter(F.col("action").isin("binary", "export")))
    held = scratch.store(_with_family(_held_names(manifest, existing)), "held")
    shared = scratch.store(
        files.select("spot")
        .unionAll(held.select("spot"))
        .groupBy("spot")
        .agg(F.count(F.lit(1)).alias("names"))
        .filter(F.col("names") > 1)
        .select("spot"),
        "shared-spots",
    )
    numbers = _numbered(files, held, shared, hot_rows)

    wanted = [*manifest.columns, "n"]
    placed = reduce(DataFrame.unionByName, [df.select(wanted) for df in numbers])
    target = entry_path(F.col("dir"), numbered(F.col("base"), F.col("n")))
    rest = manifest.filter(~F.col("action").isin("binary", "export"))
    return placed.withColumn("target", target).drop("n").unionByName(
        rest.withColumn("target", F.lit(None).cast("string"))
    )


def _numbered(
    files: DataFrame, held: DataFrame, shared: DataFrame, hot_rows: int
) -> list[DataFrame]:
    """Files with their numbers ``n``; only those at ``shared`` spots can clash."""
    hot = F.col("biggest") > hot_rows
    held = held.join(shared, "spot", "left_semi")
    contested, seen = scratch.measure(
        _contested_families(files.join(shared, "spot", "left_semi"), held),
        "contested",
        families=F.count(F.lit(1)),
        mixed=F.count_if(F.col("mixed") & ~hot),
        hot=F.max(F.when(hot, F.col("biggest"))),
        hot_mixed=F.count_if(F.col("mixed") & hot),
        size=F.sum(F.octet_length("dir") + F.octet_length("family") + 72),
    )
    zero = F.lit(0).cast("long")
    if not seen["families"]:
        return [files.withColumn("n", zero)]
    contested = sized(contested, seen["size"])
    numbers = [files.join(contested, SPOT, "left_anti").withColumn("n", zero)]
    clashing = files.join(contested, SPOT)
    if seen["size"] > BROADCAST_BYTES:  # else joined anew as cheaply as read
        clashing = scratch.store(clashing, "clashing")
    turn = F.row_number().over(Window.partitionBy("spot", *GROUP).orderBy("sort_key")) - 1
    repeated = clashing.filter(~hot & ~F.col("mixed"))
    numbers.append(repeated.withColumn("n", turn.cast("long")))
    if seen["mixed"]:
        which = F.col("mixed") & ~hot
        taken = held.join(contested.filter(which), SPOT, "left_semi")
        numbers.append(_first_free(clashing.filter(which), taken))
    if seen["hot"]:
        ranked = prefix_sum(
            clashing.filter(hot), GROUP, ["sort_key"], F.lit(1), "n", True, seen["hot"], hot_rows
        )
        numbers.append(ranked.filter(~F.col("mixed")))
    if seen["hot_mixed"]:
        which = F.col("mixed") & hot
        taken = held.join(contested.filter(which), SPOT, "left_semi")
        mixed = scratch.store(ranked.filter("mixed"), "mixed")
        numbers.append(_settle(mixed, taken, True, hot_rows))
    return numbers


def _first_free(files: DataFrame, held: DataFrame) -> DataFrame:
    """Numbers of files in one pass over each family, held names in between.

    The rows of a family come in walk order. A name that is taken stays so, so
    each base keeps a pointer behind the last number that it found taken, and no
    number is tried twice for it. Families follow one another in a partition, and
    only the names of the current one are in memory.
    """
    rows = files.withColumnRenamed("sort_key", "key").withColumns(
        {
            "stem": stem(F.col("base")),
            "suffix": suffix(F.col("base")),
            "is_file": F.lit(True),
        }
    ).unionByName(
        held.select(*SPOT, "base", "key", F.lit(False).alias("is_file")),
        allowMissingColumns=True,
    )
    in_turn = rows.repartition("spot").sortWithinPartitions(*SPOT, "key", "is_file")
    schema = StructType([*in_turn.schema.fields, StructField("n", LongType())])
    numbered_ = in_turn.mapInArrow(_number_files, schema).filter("is_file")
    return numbered_.withColumnRenamed("key", "sort_key").select(*files.columns, "n")


def _number_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``n``, the first free number of each file; null for held names."""
    family, taken, behind = None, set(), {}
    for batch in batches:
        columns = [*FAMILY, "base", "stem", "suffix", "is_file"]
        numbers = []
        for place, name, base, start, end, is_file in zip(
            *(batch.column(c).to_pylist() for c in columns)
        ):
            if (place, name) != family:
                family, taken, behind = (place, name), set(), {}
            n, wanted = None, base
            if is_file:
                n = behind.get(base, 0)
                wanted = f"{start} ({n}){end}" if n else base
                while wanted in taken:
                    n += 1
                    wanted = f"{start} ({n}){end}"
                behind[base] = n + 1
            taken.add(wanted)
            numbers.append(n)
        yield batch.append_column("n", pa.array(numbers, pa.int64()))


def _with_family(names: DataFrame) -> DataFrame:
    family = copy_family(F.col("base"))
    return names.withColumn("family", family).withColumn(
        "spot", F.xxhash64("dir", "family")
    )


def _held_names(manifest: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Names that are no file's to take, and from which point of the walk on."""
    held = (
        manifest.filter(F.col("action") == "mkdir")
        .groupBy(*GROUP)
        .agg(F.min("sort_key").alias("key"))
    )
    if existing is not None:
        path = F.col("path")
        above = F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)
        present = existing.select(clean_path("path").alias("path")).select(
            F.when(~F.contains(path, F.lit("/")), F.lit("."))
            .when(above == "", F.lit("/"))
            .otherwise(above)
            .alias("dir"),
            F.substring_index(path, "/", -1).alias("base"),
            F.expr(BEFORE_THE_WALK).alias("key"),
        )
        held = held.unionByName(present).groupBy(*GROUP).agg(F.min("key").alias("key"))
    return held


def _contested_families(files: DataFrame, held: DataFrame) -> DataFrame:
    """Families in which some file may not keep its name.

    Rows are counted by name first and by family second, both map-side, so one
    name or one family with most of the rows shuffles as a handful of counts.
    """
    names = files.groupBy(*SPOT, "base").agg(F.count(F.lit(1)).alias("n"))
    taken = held.select(*SPOT, "base", F.lit(0).alias("n"))
    return (
        names.unionByName(taken)
        .groupBy(*SPOT)
        .agg(
            F.sum("n").alias("files"),
            F.count_if(F.col("n") > 0).alias("names"),
            F.count_if(F.col("n") == 0).alias("held"),
        )
        .filter((F.col("files") > F.col("names")) | (F.col("held") > 0))
        .filter(F.col("files") > 0)
        .select(
            *SPOT,
            ((F.col("names") > 1) | (F.col("held") > 0)).alias("mixed"),
            (F.col("files") + F.col("held")).alias("biggest"),
        )
    )


def _settle(
    ranked: DataFrame, held: DataFrame, spread: bool, hot_rows: int
) -> DataFrame:
    """Numbers for files whose names meet other names of their family.

    ``n`` starts as the rank among equal names. In each round every file claims
    the name its number gives. A claim by another name (or a held name) blocks
    that number for a group of equal names from its place in the walk on; the
    group's numbers are then counted again around the blocks that stand. A
    round that changes nothing is the result of going through the walk file by
    file: each claim depends on earlier claims only, so the first k files are
    right after at most k rounds, and usually all are after two or three.

    Every step is a join, a count or a prefix sum; no family is held by a task.
    """

    def before(df, order, value, out):
        return prefix_sum(df, GROUP, order, value, out, spread, None, hot_rows)

    files = ranked.withColumn("rank", F.col("n"))
    blocks, done = None, []
    for turn in count(1):
        groups = files.select(*GROUP).distinct()
        claims = files.select(
            "dir",
            numbered(F.col("base"), F.col("n")).alias("name"),
            F.col("base").alias("by"),
            F.col("sort_key").alias("key"),
        ).unionByName(
            held.select(
                "dir", F.col("base").alias("name"), F.lit(None).alias("by"), "key"
            )
        )
        found = (
            claims.withColumn("origin", F.explode(copy_origins(F.col("name"))))
            .select("dir", "origin.*", "by", "key")
            .filter(~F.col("base").eqNullSafe(F.col("by")))
            .join(groups, GROUP, "left_semi")
            .groupBy(*GROUP, "n")
            .agg(F.min("key").alias("key"))
        )
        if blocks is None:
            found = found.withColumn("stood", F.lit(True))
        else:
            last = blocks.select(*GROUP, "n", F.col("stands").alias("stood"))
            found = found.join(last, [*GROUP, "n"], "left").withColumn(
                "stood", F.coalesce("stood", F.lit(True))
            )

        # Files of the group that come before the block in the walk.
        none = F.lit(None)
        events = found.withColumn("is_file", F.lit(0)).unionByName(
            files.select(
                *GROUP,
                none.cast("long").alias("n"),
                F.col("sort_key").alias("key"),
                none.cast("boolean").alias("stood"),
                F.lit(1).alias("is_file"),
            )
        )
        ahead = before(events, ["key"], F.col("is_file"), "ahead")
        ahead = ahead.filter(F.col("is_file") == 0)
        # It stands if those files have not reached its number.
        lower = before(ahead, ["n"], F.col("stood").cast("long"), "lower")
        stands = F.col("ahead") <= F.col("n") - F.col("lower")
        blocks, flips = scratch.measure(
            lower.withColumn("stands", stands),
            "blocks",
            flipped=F.count_if(F.col("stands") != F.col("stood")),
        )

        # A file's number is its rank plus the standing blocks it has to pass.
        standing = before(blocks.filter("stands"), ["n"], F.lit(1), "below")
        marks = standing.select(
            *GROUP,
            (F.col("n") - F.col("below")).alias("rank"),
            F.lit(0).alias("is_file"),
        )
        merged = files.withColumn("is_file", F.lit(1)).unionByName(
            marks, allowMissingColumns=True
        )
        passed = before(merged, ["rank", "is_file"], 1 - F.col("is_file"), "passed")
        renumbered, moves = scratch.measure(
            passed.filter(F.col("is_file") == 1)
            .withColumn("last_n", F.col("n"))
            .withColumn("n", F.col("rank") + F.col("passed"))
            .drop("is_file", "passed"),
            "numbered",
            moved=F.count_if(F.col("n") != F.col("last_n")),
        )
        files = renumbered.drop("last_n")
        if not moves["moved"] and not flips["flipped"]:
            done.append(files)
            return reduce(DataFrame.unionByName, done).drop("rank")

        # Families do not touch one another: from the second round on, only
        # those that still change stay in.
        if turn > 1:
            changed = renumbered.filter(F.col("n") != F.col("last_n")).select(*FAMILY)
            flipped = blocks.filter(F.col("stands") != F.col("stood"))
            flipped = flipped.select("dir", copy_family(F.col("base")).alias("family"))
            changed = scratch.store(changed.union(flipped).distinct(), "changed")
            done.append(files.join(changed, FAMILY, "left_anti"))
            files = scratch.store(files.join(changed, FAMILY, "left_semi"), "files")
            held = held.join(changed, FAMILY, "left_semi")

"""Delimited files as cell grids."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from leafgrid import scratch
from leafgrid.functions.cells import ends_quoted, join_line, split_line
from leafgrid.skew import prefix_sum, sized


def read_grid(
    spark: SparkSession, path: str, delimiter: str = ",", tab: str = "Sheet1"
) -> DataFrame:
    """Rows of text cells, as wide as each row is, blank lines kept.

    Rows end in LF or CRLF; a quoted cell may hold line breaks of any kind. Files
    are split, and a row may run over splits.

    Whether a line starts inside a cell depends on all before it. The scan notes
    for each line what both answers would lead to, and stores it; composing one
    note per split then tells where each split really starts, and how many rows
    lie before it. No line is sorted or shuffled, but for those of rows that hold
    line breaks, which are put together. The input is read once. A quote that is
    never closed makes one row of the rest of its file.
    """
    value = F.col("value")
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        ends_quoted(value, delimiter).alias("opens"),
        ends_quoted(F.concat(F.lit('"'), value), delimiter).alias("stays"),
    )
    lines = lines.withColumn("split", F.xxhash64("file", "block"))
    noted = StructType(
        lines.drop("opens", "stays", "split").schema.fields + _NOTES.fields
    )
    lines = scratch.store(lines.mapInArrow(_note_lines, noted), "lines")
    starts, seen = scratch.measure(
        _split_rows(lines), "splits", size=F.sum(F.octet_length("file") + 64)
    )
    placed = lines.join(sized(starts, seen["size"]), ["file", "block"])
    inside = F.col("inside") == 1
    rows = placed.select(
        (F.col("before") + F.when(inside, F.col("row1")).otherwise(F.col("row0"))).alias("row_num"),
        F.when(inside, F.col("alone1")).otherwise(F.col("alone0")).alias("alone"),
        "block",
        "line",
        "value",
    )
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = rows.filter(~F.col("alone")).groupBy("row_num").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    whole = rows.filter("alone").select("row_num", "value")
    whole = whole.unionByName(joined.select("row_num", text.alias("value")))
    end = F.regexp_replace("value", r"\r\z", "")
    return parse_lines(whole.withColumn("value", end), "value", "row_num", delimiter, tab)


# What a scan notes of a line: its place in the split; for a split that starts
# outside (0) or inside (1) a cell, the number of rows begun so far, whether the
# line is a row by itself, and whether it ends inside a cell.
_NOTES = StructType(
    [
        StructField("line", LongType()),
        *[
            StructField(f"{name}{start}", kind)
            for start in (0, 1)
            for name, kind in (("row", LongType()), ("alone", BooleanType()), ("ends", BooleanType()))
        ],
    ]
)


def _note_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows both starts through the lines of each split, in scan order."""
    split, line, rows, inside = None, 0, [0, 0], [False, True]
    for batch in batches:
        opens, stays, splits = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays", "split")
        )
        edges = np.flatnonzero(np.diff(splits)) + 1
        notes = {f.name: [] for f in _NOTES.fields}
        for begin, end in pairwise([0, *edges.tolist(), len(splits)]):
            if begin == end:
                continue
            if splits[begin] != split:
                split, line, rows, inside = splits[begin], 0, [0, 0], [False, True]
            notes["line"].append(np.arange(line, line + end - begin))
            line += end - begin
            for s in (0, 1):
                after = _follow(opens[begin:end], stays[begin:end], inside[s])
                before = np.concatenate([[inside[s]], after[:-1]])
                begun = rows[s] + np.cumsum(~before)
                notes[f"row{s}"].append(begun)
                notes[f"alone{s}"].append(~before & ~after)
                notes[f"ends{s}"].append(after)
                rows[s], inside[s] = int(begun[-1]), bool(after[-1])
        if len(splits):
            columns = [batch.column(c) for c in ("value", "file", "block")]
            columns += [pa.array(np.concatenate(notes[f.name])) for f in _NOTES.fields]
            yield pa.RecordBatch.from_arrays(columns, ["value", "file", "block", *notes])


def _follow(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """The state behind each line.

    A line either ends the same from both states, keeps the state, or swaps it; so
    the state is that of the last line of the first kind, swapped as often since.
    """
    swaps = np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
    known = last >= 0
    state = np.where(known, opens[last], inside)
    since = swaps - np.where(known, swaps[last], 0)
    return state ^ (since % 2 == 1)


def _split_rows(lines: DataFrame) -> DataFrame:
    """For each split whether it starts inside a cell and the rows before it.

    Splits are ordered within their file only, and files by a spread prefix sum.
    """
    ends = lines.groupBy("file", "block").agg(
        F.max(F.struct("line", "ends0", "ends1", "row0", "row1")).alias("end")
    )
    ends = ends.select("file", "block", "end.*")
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("ends0") == F.col("ends1")
    swap = (F.col("ends0") & ~F.col("ends1")).cast("int")
    ends = ends.withColumn("swaps", F.sum(swap).over(upto))
    fixed = F.when(same, F.struct(F.col("ends0").cast("int").alias("state"), "swaps"))
    ends = ends.withColumns(
        {
            "fixed": F.last(fixed, ignorenulls=True).over(before),
            "seen": F.coalesce(F.sum(swap).over(before), F.lit(0)),
        }
    )
    since = F.col("seen") - F.coalesce("fixed.swaps", F.lit(0))
    ends = ends.withColumn("inside", (F.coalesce("fixed.state", F.lit(0)) + since) % 2)
    rows = F.when(F.col("inside") == 1, F.col("row1")).otherwise(F.col("row0"))
    ends = ends.withColumn("earlier", F.coalesce(F.sum(rows).over(before), F.lit(0)))
    ends = scratch.store(ends.withColumn("rows", rows), "split-ends")
    files = ends.groupBy("file").agg(F.sum("rows").alias("rows"))
    files = prefix_sum(files, [], ["file"], F.col("rows"), "file_start", spread=True)
    return ends.join(files.select("file", "file_start"), "file").select(
        "file", "block", "inside", (F.col("file_start") + F.col("earlier")).alias("before")
    )


def read_grid_multiline(
    spark: SparkSession,
    path: str,
    width: int,
    delimiter: str = ",",
    tab: str = "Sheet1",
) -> DataFrame:
    """Spark's own reader of cells with line breaks, up to ``width`` columns.

    ``read_grid`` reads such cells, too, and splits files. Here a file is read by one task. The reader drops blank lines, so they do not
    count as rows, and cells missing at the end of a line are left out.
    """
    names = [f"c{i}" for i in range(width)]
    schema = StructType([StructField(name, StringType()) for name in names])
    rows = spark.read.schema(schema).csv(
        path,
        sep=delimiter,
        multiLine=True,
        quote='"',
        escape='"',
        nullValue="\x00",
        lineSep="\n",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    rows = rows.select(
        F.array(*names).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
    )
    given = F.filter("value", lambda v: v.isNotNull())
    # With a line feed inside the first cells the reader takes that for the line
    # end and leaves the carriage return of a CRLF file on the last cell.
    given = F.transform(
        given,
        lambda v, i: F.when(
            i == F.size(given) - 1, F.regexp_replace(v, r"\r\z", "")
        ).otherwise(v),
    )
    return _as_grid(rows.join(_split_starts(rows), ["file", "block"]), tab, given)


def parse_lines(
    df: DataFrame, line: str, row_num: str, delimiter: str = ",", tab: str = "Sheet1"
) -> DataFrame:
    """A grid from delimited lines held in a column beside their row numbers."""
    return df.select(
        F.lit(tab).alias("tab"),
        F.lit(0).alias("tab_ord"),
        F.col(row_num).cast("long").alias("row_num"),
        split_line(F.col(line), delimiter).alias("cells"),
    )


def write_grid(
    grid: DataFrame,
    path: str,
    delimiter: str = ",",
    line_sep: str = "\r\n",
    tab: str | None = None,
) -> None:
    """Write the rows of one tab in order as delimited text, the first tab unless
    one is named; read the parts by name."""
    if tab is None:
        wanted = grid.agg(F.min_by("tab", "tab_ord")).scalar()
    elif grid.filter(F.col("tab") == tab).isEmpty():
        raise ValueError(f"no tab named {tab!r}")
    else:
        wanted = F.lit(tab)
    rows = rendered_lines(grid.filter(F.col("tab") == wanted), delimiter)
    rows.select("line").write.mode("overwrite").text(path, lineSep=line_sep)


def rendered_lines(grid: DataFrame, delimiter: str = ",") -> DataFrame:
    """``row_num`` and the delimited ``line`` of each row, in row order."""
    return grid.select(
        "row_num", join_line(F.col("cells"), delimiter).alias("line")
    ).orderBy("row_num")


def _split_starts(rows: DataFrame) -> DataFrame:
    """First row marker of each file split and the rows in the splits before it."""
    in_file_order = Window.orderBy("file", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.groupBy("file", "block")
        .agg(F.min("seen").alias("first_seen"), F.count(F.lit(1)).alias("rows"))
        .select(
            "file",
            "block",
            "first_seen",
            F.coalesce(F.sum("rows").over(in_file_order), F.lit(0)).alias("earlier"),
        )
    )


def _as_grid(rows: DataFrame, tab: str, cells) -> DataFrame:
    return rows.select(
        F.lit(tab).alias("tab"),
        F.lit(0).alias("tab_ord"),
        (F.col("earlier") + F.col("seen") - F.col("first_seen") + 1).alias("row_num"),
        cells.alias("cells"),
    )

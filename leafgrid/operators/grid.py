"""Range reads and writes on cell grids.

A grid has one row per sheet row (``tab``, ``tab_ord``, ``row_num``, ``cells``),
blank rows included. Writes return a new grid; the caller saves it elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.functions.cells import Rectangle, parse_a1, quote_tab, trim_cells

GRID_COLUMNS = ["tab", "tab_ord", "row_num", "cells"]
NO_CELLS = "CAST(array() AS ARRAY<STRING>)"


class Written(NamedTuple):
    """A changed grid and what was written to it."""

    grid: DataFrame
    updated_range: str
    updated_rows: int
    updated_cells: int


def tabs(grid: DataFrame) -> DataFrame:
    """Tab titles in workbook order."""
    return grid.groupBy("tab").agg(F.min("tab_ord").alias("tab_ord")).orderBy("tab_ord")


def first_tab(grid: DataFrame) -> str:
    tab = grid.agg(F.min_by("tab", "tab_ord")).first()[0]
    if tab is None:
        raise ValueError("an empty grid has no first tab")
    return tab


def locate(grid: DataFrame, range_: str | None) -> tuple[str, Rectangle]:
    """The tab a range is on, the first one unless it names another."""
    rectangle = parse_a1(range_)
    if rectangle.tab is None:
        return first_tab(grid), rectangle
    if grid.filter(F.col("tab") == rectangle.tab).isEmpty():
        raise ValueError(f"no tab named {rectangle.tab!r}")
    return rectangle.tab, rectangle


def read_range(grid: DataFrame, range_: str | None = None) -> DataFrame:
    """Rows of a range, each up to its last non-empty cell.

    ``row_num`` stays the sheet's. Blank rows after the last filled one are left
    out, so an empty range has no rows.
    """
    tab, rectangle = locate(grid, range_)
    start = rectangle.first_col or 0
    if rectangle.last_col is None:
        width = F.greatest(F.size("cells") - start, F.lit(0))
    else:
        width = F.lit(rectangle.last_col - start + 1)
    rows = grid.filter((F.col("tab") == tab) & _in_rows(rectangle)).select(
        "tab",
        "tab_ord",
        "row_num",
        trim_cells(F.slice("cells", F.lit(start + 1), width)).alias("cells"),
    )
    filled = F.when(F.size("cells") > 0, F.col("row_num"))
    return rows.filter(F.col("row_num") <= rows.agg(F.max(filled)).scalar())


def update_range(grid: DataFrame, range_: str | None, values: DataFrame) -> Written:
    """Write ``values`` (``row_num`` from 1, ``cells``) over a range.

    Rows shorter than the widest one are filled with blanks; a null cell leaves
    the old value. Values must fit a range that has an end.
    """
    tab, rectangle = locate(grid, range_)
    top, left = rectangle.first_row or 1, rectangle.first_col or 0
    shape = _shape(values)
    _check_fit(rectangle, top, left, shape)
    if not shape["height"]:
        return Written(grid, rectangle.a1(tab), 0, 0)

    width = shape["width"]
    written = values.select(
        (F.col("row_num") + (top - 1)).alias("row_num"),
        _padded(F.col("cells"), F.lit(width)).alias("written"),
    )
    on_tab = _with_rows_up_to(grid, tab, top - 1)
    merged = on_tab.join(written, "row_num", "full").select(
        F.lit(tab).alias("tab"),
        F.coalesce("tab_ord", F.lit(_tab_ord(grid, tab))).alias("tab_ord"),
        "row_num",
        F.when(F.col("written").isNull(), F.col("cells"))
        .otherwise(_spliced(left, width))
        .alias("cells"),
    )
    area = Rectangle(tab, top, top + shape["height"] - 1, left, left + width - 1)
    others = grid.filter(F.col("tab") != tab).select(*GRID_COLUMNS)
    return Written(
        others.unionByName(merged), area.a1(tab), shape["rows"], shape["cells"]
    )


def append_rows(grid: DataFrame, range_: str | None, values: DataFrame) -> Written:
    """Write ``values`` below the last filled row, from the range's first column."""
    tab, rectangle = locate(grid, range_)
    left = rectangle.first_col or 0
    shape = _shape(values)
    on_tab = grid.filter(F.col("tab") == tab)
    filled = F.when(F.size(trim_cells(F.col("cells"))) > 0, F.col("row_num"))
    last = on_tab.agg(F.max(filled)).first()[0] or 0
    if not shape["height"]:
        return Written(grid, rectangle.a1(tab), 0, 0)

    blank = F.array_repeat(F.lit(""), left)
    below = values.select(
        F.lit(tab).alias("tab"),
        F.lit(_tab_ord(grid, tab)).alias("tab_ord"),
        (F.col("row_num") + last).alias("row_num"),
        trim_cells(F.concat(blank, "cells")).alias("cells"),
    )
    kept = grid.filter((F.col("tab") != tab) | (F.col("row_num") <= last))
    area = Rectangle(
        tab, last + 1, last + shape["height"], left, left + shape["width"] - 1
    )
    return Written(
        kept.select(*GRID_COLUMNS).unionByName(below),
        area.a1(tab),
        shape["rows"],
        shape["cells"],
    )


def clear_range(grid: DataFrame, range_: str | None) -> tuple[DataFrame, str]:
    """Blank the cells of a range; rows stay. Also gives the range as A1 text."""
    tab, rectangle = locate(grid, range_)
    first, last = rectangle.first_col or 0, rectangle.last_col

    def blanked(value: Column, position: Column) -> Column:
        inside = position >= first
        if last is not None:
            inside = inside & (position <= last)
        return F.when(inside, F.lit("")).otherwise(value)

    hit = (F.col("tab") == tab) & _in_rows(rectangle)
    cells = F.when(hit, trim_cells(F.transform("cells", blanked)))
    cleared = grid.withColumn("cells", cells.otherwise(F.col("cells")))
    return cleared.select(*GRID_COLUMNS), rectangle.a1(tab)


def parse_edits(writes: DataFrame) -> DataFrame:
    """Cell edits from (``range``, ``values``, ``seq``) writes.

    ``range`` is A1 text whose first corner places the array of rows ``values``.
    """
    text = F.col("range")
    quoted = F.regexp_extract(text, r"(?s)^'((?:[^']|'')*)'!", 1)
    plain = F.regexp_extract(text, r"(?s)^([^'].*)!", 1)
    corner = F.regexp_extract(text, r"([A-Za-z]+)[0-9]+(?::[A-Za-z]+[0-9]+)?\z", 1)
    row = F.regexp_extract(text, r"[A-Za-z]+([0-9]+)(?::[A-Za-z]+[0-9]+)?\z", 1)
    column = F.aggregate(
        F.split(F.upper(corner), ""),
        F.lit(0),
        lambda total, letter: total * 26 + F.ascii(letter) - 64,
    )
    rows = writes.select(
        F.coalesce(
            F.nullif(F.replace(quoted, F.lit("''"), F.lit("'")), F.lit("")), plain
        ).alias("tab"),
        row.cast("long").alias("top"),
        (column - 1).alias("left"),
        F.col("seq"),
        F.posexplode("values").alias("down", "cells"),
    )
    return rows.select(
        "tab",
        (F.col("top") + F.col("down")).alias("row_num"),
        "left",
        "seq",
        F.posexplode("cells").alias("right", "value"),
    ).select(
        "tab",
        "row_num",
        (F.col("left") + F.col("right")).alias("col_idx"),
        "value",
        "seq",
    )


def apply_edits(grid: DataFrame, edits: DataFrame) -> tuple[DataFrame, int]:
    """Write scattered cells in one pass; the last ``seq`` wins a cell.

    A row that the grid leaves out, before its last one or after, is added.

    ``edits`` has ``tab``, ``row_num``, ``col_idx``, ``value`` and ``seq``. Also
    gives the number of cells written.
    """
    known = grid.groupBy("tab").agg(
        F.min("tab_ord").alias("tab_ord"), F.max("row_num").alias("rows")
    )
    reach = edits.groupBy("tab").agg(
        F.max("row_num").alias("reach"), F.count(F.lit(1)).alias("cells")
    )
    extents = reach.join(known, "tab", "left").collect()  # one row per tab
    unknown = [r["tab"] for r in extents if r["tab_ord"] is None]
    if unknown:
        raise ValueError(f"no tab named {unknown[0]!r}")

    grid = grid.select(*GRID_COLUMNS)
    for r in extents:
        if r["reach"] > r["rows"]:
            grid = grid.unionByName(
                _blank_rows(grid, r["tab"], r["tab_ord"], r["rows"], r["reach"])
            )
    edited = (
        edits.groupBy("tab", "row_num", "col_idx")
        .agg(F.max_by("value", "seq").alias("value"))
        .groupBy("tab", "row_num")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias(
                "edit"
            ),
            F.max("col_idx").alias("last"),
        )
    )
    positions = F.sequence(
        F.lit(0), F.greatest(F.size("cells") - 1, F.col("last").cast("int"))
    )
    cells = F.transform(
        positions,
        lambda i: F.coalesce(
            F.try_element_at("edit", i.cast("int")), F.get("cells", i), F.lit("")
        ),
    )
    edited = edited.withColumn("edit", F.col("edit").cast("map<int,string>"))
    order = F.lit(None).cast(grid.schema["tab_ord"].dataType)
    for r in extents:
        order = F.when(F.col("tab") == r["tab"], r["tab_ord"]).otherwise(order)
    changed = grid.join(edited, ["tab", "row_num"], "full").withColumns(
        {
            "tab_ord": F.coalesce("tab_ord", order),
            "cells": F.when(F.col("edit").isNull(), F.col("cells")).otherwise(
                trim_cells(cells)
            ),
        }
    )
    return changed.select(*GRID_COLUMNS), sum(r["cells"] for r in extents)


def parse_cells(grid: DataFrame, mode: str = "USER_ENTERED") -> DataFrame:
    """One row per filled cell, with the value typed as if entered by hand.

    ``RAW`` keeps text only. A cell starting ``=``, ``+``, ``-`` or ``@`` is
    flagged and never evaluated.
    """
    if mode not in ("RAW", "USER_ENTERED"):
        raise ValueError(f"mode must be 'RAW' or 'USER_ENTERED', not {mode!r}")
    cells = grid.select(
        "tab", "row_num", F.posexplode("cells").alias("col_idx", "text")
    ).filter(F.col("text") != "")
    entered = F.when(F.lit(mode == "USER_ENTERED"), F.trim("text"))
    whole = F.when(entered.rlike(r"^[+-]?[0-9]+$"), entered).try_cast("bigint")
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    decimal = F.when(entered.rlike(number), entered).try_cast("double")
    day = F.when(entered.rlike(r"^\d{4}-\d\d-\d\d$"), entered).try_cast("date")
    return cells.select(
        "tab",
        "row_num",
        "col_idx",
        "text",
        whole.alias("as_long"),
        decimal.alias("as_double"),
        day.alias("as_date"),
        F.col("text").rlike(r"^[=+\-@]").alias("formula_risk"),
    )


def _in_rows(rectangle: Rectangle) -> Column:
    inside = F.lit(True)
    if rectangle.first_row is not None:
        inside = F.col("row_num") >= rectangle.first_row
    if rectangle.last_row is not None:
        inside = inside & (F.col("row_num") <= rectangle.last_row)
    return inside


def _shape(values: DataFrame) -> dict[str, int]:
    sizes = values.agg(
        F.coalesce(F.max("row_num"), F.lit(0)).alias("height"),
        F.count(F.lit(1)).alias("rows"),
        F.greatest(F.max(F.size("cells")), F.lit(1)).alias("width"),
        F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("cells"),
    )
    return sizes.first().asDict()


def _check_fit(rectangle: Rectangle, top: int, left: int, shape: dict) -> None:
    area = rectangle
    one_cell = (area.first_row, area.first_col) == (area.last_row, area.last_col)
    if one_cell and area.first_row is not None:
        return  # a single cell says where to start, not how much fits
    too_high = area.last_row is not None and top + shape["height"] - 1 > area.last_row
    too_wide = area.last_col is not None and left + shape["width"] - 1 > area.last_col
    if shape["height"] and (too_high or too_wide):
        raise ValueError("values do not fit the range")


def _padded(cells: Column, width: Column) -> Column:
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.concat(cells, F.array_repeat(F.lit(""), missing))


def _spliced(left: int, width: int) -> Column:
    old = F.coalesce("cells", F.expr(NO_CELLS))
    before = _padded(F.slice(old, 1, left), F.lit(left))
    middle = F.transform(
        "written", lambda v, i: F.coalesce(v, F.get(old, i + left), F.lit(""))
    )
    after_size = F.greatest(F.size(old) - (left + width), F.lit(0))
    after = F.slice(old, F.lit(left + width + 1), after_size)
    return trim_cells(F.concat(before, middle, after))


def _tab_ord(grid: DataFrame, tab: str) -> int:
    return grid.filter(F.col("tab") == tab).agg(F.min("tab_ord")).first()[0]


def _blank_rows(
    grid: DataFrame, tab: str, tab_ord: int, last: int, until: int
) -> DataFrame:
    """Blank rows ``last + 1`` to ``until`` of a tab."""
    return grid.sparkSession.range(last + 1, until + 1).select(
        F.lit(tab).alias("tab"),
        F.lit(tab_ord).cast("int").alias("tab_ord"),
        F.col("id").alias("row_num"),
        F.expr(NO_CELLS).alias("cells"),
    )


def _with_rows_up_to(grid: DataFrame, tab: str, until: int) -> DataFrame:
    on_tab = grid.filter(F.col("tab") == tab).select(*GRID_COLUMNS)
    last = on_tab.agg(F.max("row_num")).first()[0] or 0
    if last >= until:
        return on_tab
    return on_tab.unionByName(
        _blank_rows(grid, tab, _tab_ord(grid, tab), last, until)
    )

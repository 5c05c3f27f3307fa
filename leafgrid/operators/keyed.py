"""Finding and setting grid rows by header-named columns."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.functions.cells import column_letter, letter_of, quote_tab, trim_cells
from leafgrid.operators.grid import GRID_COLUMNS
from leafgrid.skew import sized


# What instructions and rows meet on: the kind of key and the values in its columns.
KEY = ["kind", "key"]

# Why an update is refused, by status.
REFUSALS = {
    "no_updates": "nothing to write, as no columns are given",
    "empty_tab": "the tab has no filled cell, so there are no column names",
    "unknown_target": "a column to write has no header",
    "unknown_match": "a column of the conditions has no header",
    "no_match": "no data row meets the conditions",
    "ambiguous": "several data rows meet the conditions; find_rows returns them, "
    "allow_multiple writes to all",
}


class Refused(ValueError):
    """An update that writes nothing: its status and the rows that it met."""

    def __init__(self, status: str, rows: int = 0, about: str = ""):
        super().__init__(f"{status}, {rows} rows: {REFUSALS[status]} {about}".rstrip())
        self.status, self.rows = status, rows


class KeyedUpdate(NamedTuple):
    """The changed grid, the cells written, and the number of rows and cells."""

    grid: DataFrame
    edits: DataFrame
    rows: int
    updated_cells: int


class BatchUpdate(NamedTuple):
    """The changed grid, the cells written, and a status per instruction."""

    grid: DataFrame
    edits: DataFrame
    results: DataFrame


class Facts(NamedTuple):
    """A tab, the cells of its first row, and its last filled row.

    ``header`` is None without a first row or any filled cell.
    """

    tab: str
    header: list[str] | None
    last_row: int | None


def facts_of(grid: DataFrame, tab: str | None = None) -> Facts:
    """The facts of a tab, the first one unless one is named, in a single job."""
    rows = grid if tab is None else grid.filter(F.col("tab") == tab)
    filled = F.when(F.exists("cells", lambda v: v != ""), F.col("row_num"))
    first = F.when(F.col("row_num") == 1, trim_cells(F.col("cells")))
    found = (
        rows.groupBy("tab")
        .agg(F.min("tab_ord").alias("ord"), F.max(first), F.max(filled))
        .orderBy("ord")
        .first()
    )
    if found is None:
        raise ValueError(
            "an empty grid has no first tab" if tab is None else f"no tab named {tab!r}"
        )
    name, _, header, last_row = found
    return Facts(name, None if last_row is None else header, last_row)


def to_table(grid: DataFrame, tab: str | None = None) -> DataFrame:
    """``row_num`` and one text column per header.

    Column names differ without regard to case: a name that ``row_num`` or a
    header to its left has gets ``__2``, or the next number that no header has.
    """
    facts = facts_of(grid, tab)
    names = _unique_names(facts.header or [])
    columns = [_cell(i).alias(n) for i, n in enumerate(names)]
    return _data_rows(grid, facts).select("row_num", *columns)


def _unique_names(header: list[str]) -> list[str]:
    given = {name.lower() for name in header}
    used, names = {"row_num"}, []
    for name in header:
        unique, number = name, 1
        while unique.lower() in used or (number > 1 and unique.lower() in given):
            number += 1
            unique = f"{name}__{number}"
        used.add(unique.lower())
        names.append(unique)
    return names


def find_rows(
    grid: DataFrame, match: dict[str, str], tab: str | None = None
) -> DataFrame:
    """Sheet row numbers of the data rows whose columns all equal ``match``.

    A missing cell equals the empty string; no conditions match every data row.
    """
    return _found_rows(grid, facts_of(grid, tab), match)


def _found_rows(grid: DataFrame, facts: Facts, match: dict[str, str]) -> DataFrame:
    if facts.header is None:
        return grid.select("row_num").filter(F.lit(False))
    hit = _matches(facts.header, match)
    return _data_rows(grid, facts).filter(hit).select("row_num")


def set_by_match(
    grid: DataFrame,
    match: dict[str, str],
    updates: dict[str, str],
    tab: str | None = None,
    allow_multiple: bool = False,
) -> KeyedUpdate:
    """Set columns on the one row that meets all conditions.

    ``set_by_keys`` for a single instruction: whatever status other than ``ok``
    that gives is raised as ``Refused``, before anything is written.
    """
    facts = facts_of(grid, tab)
    tab, header, _ = facts
    about = f"(tab {tab!r}, where {match}, set {updates})"
    names = [F.lit(list(columns)).cast("array<string>") for columns in (match, updates)]
    # Worked out while the plan is optimised, without a job.
    one = grid.sparkSession.sql("VALUES (1)").select(_status(header, *names)).first()
    if one[0] is not None:
        raise Refused(one[0], about=about)
    matched = _found_rows(grid, facts, match)
    n = F.count(F.lit(1))
    rows, outcome = matched.agg(n, _outcome(n, allow_multiple)).first()
    if outcome != "ok":
        raise Refused(outcome, rows, about)

    places = {header.index(column): value for column, value in updates.items()}
    order = {header.index(column): i for i, column in enumerate(updates)}
    hit = _is_data(facts) & _matches(header, match)
    widest = max(places) + 1
    cells = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("cells"), F.lit(widest)) - 1),
        lambda i: F.coalesce(
            _literal_choice(i, places), F.get("cells", i), F.lit("")
        ),
    )
    changed = grid.withColumn(
        "cells", F.when(hit, trim_cells(cells)).otherwise(F.col("cells"))
    ).select(*GRID_COLUMNS)

    entries = [
        F.struct(
            F.lit(position).alias("col_idx"),
            F.concat(
                F.lit(f"{quote_tab(tab)}!{column_letter(position)}"), F.col("row_num")
            ).alias("a1"),
            F.lit(value).alias("value"),
            (F.col("row_num") * len(places) + order[position]).alias("seq"),
        )
        for position, value in places.items()
    ]
    edits = matched.select(
        F.lit(tab).alias("tab"), "row_num", F.inline(F.array(*entries))
    )
    return KeyedUpdate(changed, edits, rows, rows * len(places))


def parse_pairs(df: DataFrame, pairs: str, out: str) -> DataFrame:
    """Adds the map of an array of ``COLUMN=VALUE`` texts, and ``<out>_error``.

    A text splits at its first ``=``; the column is trimmed, the value is not;
    the last of a repeated column counts.
    """
    blanks = r"(?U)^\s+|\s+\z"

    def split(pair: Column) -> Column:
        at = F.instr(pair, "=")
        return F.struct(
            F.regexp_replace(F.substring(pair, F.lit(1), at - 1), blanks, "").alias("key"),
            F.substring(pair, at + 1, F.length(pair)).alias("value"),
        )

    entries = F.transform(pairs, split)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]
        ),
    )
    no_sign = F.exists(pairs, lambda p: ~F.contains(p, F.lit("=")))
    no_name = F.exists(entries, lambda e: e["key"] == "")
    error = F.when(no_sign, "must be COLUMN=VALUE").when(no_name, "empty column name")
    return df.withColumn(f"{out}_error", error).withColumn(
        out, F.when(error.isNull(), F.map_from_entries(last))
    )


def set_by_keys(
    grid: DataFrame,
    instructions: DataFrame,
    tab: str | None = None,
    allow_multiple: bool = False,
) -> BatchUpdate:
    """``set_by_match`` for a table of instructions against one state of the grid.

    ``instructions`` has ``seq`` and the maps ``match`` and ``updates``. Each gets
    a status (``ok``, ``no_updates``, ``empty_tab``, ``unknown_target``,
    ``unknown_match``, ``no_match``, ``ambiguous``) and its row count; only ``ok``
    ones write, and the highest ``seq`` wins a cell.

    A kind of key is a set of columns to match on; its number and the values in
    those columns are the key. Every grid row has a key of each kind that occurs,
    so instructions of all kinds meet the rows in the same joins, and the number
    of jobs does not depend on them. Only keys that are asked for are shuffled and
    counted, and the instructions of one key are folded to one row, so a row meets
    at most one partner of each kind. What is written to a row is joined back once.
    """
    facts = facts_of(grid, tab)
    tab, header, _ = facts
    # Column names only: as many as there are kinds of keys.
    checked, seen = scratch.measure(
        _checked(instructions, header),
        "instructions",
        kinds=F.collect_set(F.when(F.col("status").isNull(), F.col("columns"))),
    )
    refused = checked.filter(F.col("status").isNotNull()).select(
        "seq", "status", F.lit(0).cast("long").alias("n_rows")
    )
    kinds = sorted(list(columns) for columns in seen["kinds"] or [])
    if not kinds:
        return BatchUpdate(grid, _no_edits(grid), refused)

    data = _data_rows(grid, facts)
    named = F.array(*[F.lit(columns).cast("array<string>") for columns in kinds])
    valid = checked.filter(F.col("status").isNull()).select(
        "seq",
        "updates",
        (F.array_position(named, F.col("columns")) - 1).cast("int").alias("kind"),
        F.transform("columns", lambda c: F.element_at("match", c)).alias("key"),
    )
    # Keys that no instruction asks for leave before anything is shuffled.
    wanted, seen = scratch.measure(
        valid.select(*KEY).distinct(),
        "wanted",
        size=F.sum(F.octet_length(F.array_join("key", "")) + 64),
    )
    keys = F.array(
        *[
            F.array(*[_cell(header.index(c)) for c in columns]).cast("array<string>")
            for columns in kinds
        ]
    )
    hits = scratch.store(
        data.select("row_num", F.posexplode(keys).alias(*KEY)).join(
            sized(wanted, seen["size"]), KEY, "left_semi"
        ),
        "hits",
    )
    # Stored, so that the join can split a key with very many instructions.
    counts = scratch.store(hits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "counts")
    n = F.coalesce("n", F.lit(0))
    judged = scratch.store(
        valid.join(counts, KEY, "left").select(
            "seq",
            *KEY,
            "updates",
            _outcome(n, allow_multiple).alias("status"),
            n.alias("n_rows"),
        ),
        "judged",
    )
    results = refused.unionByName(judged.select("seq", "status", "n_rows"))
    folded, seen = scratch.measure(
        _folded(judged, header),
        "folded",
        size=F.sum(F.octet_length(F.to_json(F.struct("key", "cells"))) + 64),
    )
    written, seen = scratch.measure(
        _latest(
            hits.join(sized(folded, seen["size"]), KEY).select("row_num", F.inline("cells")),
            "row_num",
        ),
        "written",
        size=F.sum(F.octet_length(F.to_json("cells")) + 64),
    )
    edits = written.select("row_num", F.inline("cells")).select(
        F.lit(tab).alias("tab"),
        "row_num",
        F.col("place").alias("col_idx"),
        F.concat(
            F.lit(quote_tab(tab) + "!"), letter_of(F.col("place")), F.col("row_num")
        ).alias("a1"),
        "value",
        "seq",
    )
    return BatchUpdate(
        _with_cells(grid, facts, data, sized(written, seen["size"])), edits, results
    )


def _with_cells(
    grid: DataFrame, facts: Facts, data: DataFrame, written: DataFrame
) -> DataFrame:
    """The grid with the written cells of each row, the other rows as they were."""
    values = F.map_from_entries(
        F.transform("written", lambda c: F.struct(c["place"], c["value"]))
    )
    cells = F.transform(
        F.sequence(
            F.lit(0),
            F.greatest(F.size("cells") - 1, F.array_max(F.map_keys("values"))),
        ),
        lambda i: F.coalesce(F.element_at("values", i), F.get("cells", i), F.lit("")),
    )
    changed = (
        data.join(written.withColumnRenamed("cells", "written"), "row_num", "left")
        .withColumn("values", values)
        .withColumn(
            "cells",
            F.when(F.col("values").isNotNull(), trim_cells(cells)).otherwise(F.col("cells")),
        )
    )
    rest = grid.filter(~F.coalesce(_is_data(facts), F.lit(False)))
    return rest.select(*GRID_COLUMNS).unionByName(changed.select(*GRID_COLUMNS))


def _is_data(facts: Facts) -> Column:
    """Whether a row lies below the header and not below the last filled row."""
    rows = F.col("row_num").between(2, F.lit(facts.last_row).cast("long"))
    return (F.col("tab") == facts.tab) & rows


def _data_rows(grid: DataFrame, facts: Facts) -> DataFrame:
    return grid.filter(_is_data(facts)).select(
        "tab", "tab_ord", "row_num", trim_cells(F.col("cells")).alias("cells")
    )


def _cell(position: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(position)), F.lit(""))


def _matches(header: list[str], match: dict[str, str]) -> Column:
    lacking = match.keys() - set(header)
    if lacking:
        raise Refused("unknown_match", about=f"({sorted(lacking)})")
    tests = [_cell(header.index(column)) == value for column, value in match.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def _literal_choice(position: Column, values: dict[int, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for place, value in values.items():
        chosen = F.when(position == place, F.lit(value)).otherwise(chosen)
    return chosen


def _status(header: list[str] | None, match: Column, updates: Column) -> Column:
    """Why an instruction is refused by its column names alone; null if it is not."""
    names = F.lit(header or []).cast("array<string>")

    def unknown(columns: Column) -> Column:
        return F.size(F.array_except(columns, names)) > 0

    return (
        F.when(F.size(updates) == 0, "no_updates")
        .when(F.lit(header is None), "empty_tab")
        .when(unknown(updates), "unknown_target")
        .when(unknown(match), "unknown_match")
    )


def _outcome(rows: Column, allow_multiple: bool) -> Column:
    """The status of an instruction that meets so many rows."""
    return (
        F.when(rows == 0, "no_match")
        .when((rows > 1) & ~F.lit(allow_multiple), "ambiguous")
        .otherwise("ok")
    )


def _checked(instructions: DataFrame, header: list[str] | None) -> DataFrame:
    status = _status(header, F.map_keys("match"), F.map_keys("updates"))
    return instructions.select(
        "seq",
        "match",
        "updates",
        F.array_sort(F.map_keys("match")).alias("columns"),
        status.alias("status"),
    )


def _folded(judged: DataFrame, header: list[str]) -> DataFrame:
    """One row per key: the latest value for each column position."""
    positions = F.create_map(
        *[F.lit(x) for name in dict.fromkeys(header) for x in (name, header.index(name))]
    )
    cells = judged.filter(F.col("status") == "ok").select(
        *KEY, "seq", F.explode("updates").alias("column", "value")
    )
    place = F.element_at(positions, F.col("column")).alias("place")
    return _latest(cells.select(*KEY, place, "seq", "value"), *KEY)


def _latest(cells: DataFrame, *by: str) -> DataFrame:
    """One row of ``cells`` per key, the value of the highest ``seq`` in each place."""
    last = cells.groupBy(*by, "place").agg(F.max(F.struct("seq", "value")).alias("last"))
    cell = F.struct("place", F.col("last.seq"), F.col("last.value"))
    return last.groupBy(*by).agg(F.collect_list(cell).alias("cells"))


def _no_edits(grid: DataFrame) -> DataFrame:
    return grid.limit(0).select(
        "tab",
        "row_num",
        F.lit(0).alias("col_idx"),
        F.lit("").alias("a1"),
        F.lit("").alias("value"),
        F.lit(0).cast("long").alias("seq"),
    )

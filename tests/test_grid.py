import csv
from itertools import product
from string import ascii_uppercase

import pytest
from pyspark.sql import functions as F

from leafgrid.functions.cells import column_letter, letter_of, parse_a1, quote_tab
from leafgrid.operators.grid import (
    append_rows, apply_edits, clear_range, first_tab, parse_cells, parse_edits,
    read_range, tabs, update_range,
)
from leafgrid.operators.keyed import (
    REFUSALS, Refused, find_rows, parse_pairs, set_by_keys, set_by_match, to_table,
)
from leafgrid.schemas import GRID
from leafgrid.sources.grids import read_grid, read_grid_multiline, write_grid

# Trees of an orchard; the last two rows agree in all but their number.
TREES = [
    ["plot", "tree", "sort", "crates", "pruned"],
    ["north", "16", "Cox", "3"],
    ["north", "17", "Cox", "11", "yes"],
    ["south", "16", "Boskoop"],
    ["south", "18", "Rubinette", "4"],
    ["south", "19", "Rubinette", "4"],
]


def grid(spark, *rows_of_tabs, names=("Sheet1", "Q3 Budget")):
    rows = [
        (names[t], t, i + 1, cells)
        for t, cell_rows in enumerate(rows_of_tabs)
        for i, cells in enumerate(cell_rows)
    ]
    return spark.createDataFrame(rows, GRID)


def values(spark, rows):
    return grid(spark, rows).select("row_num", "cells")


def cells(df, tab="Sheet1"):
    rows = df.filter(F.col("tab") == tab).orderBy("row_num").collect()
    assert [r["row_num"] for r in rows] == list(range(1, len(rows) + 1))
    return [list(r["cells"]) for r in rows]


def numbers(df):
    return sorted(r["row_num"] for r in df.collect())


def test_column_letters_count_up(spark):
    """All names of up to three letters, in order of length and alphabet."""
    names = ["".join(n) for k in (1, 2, 3) for n in product(ascii_uppercase, repeat=k)]
    assert [column_letter(i) for i in range(len(names))] == names
    found = spark.range(len(names)).orderBy("id").select(letter_of(F.col("id").cast("int")))
    assert [r[0] for r in found.collect()] == names
    for before in (-1, -26, -27):
        with pytest.raises(ValueError):
            column_letter(before)


def test_a1_text():
    assert quote_tab("it's") == "'it''s'"
    assert parse_a1("Sheet1!A1:C10") == ("Sheet1", 1, 10, 0, 2)
    assert parse_a1("'Q3 ''x'!B2") == ("Q3 'x", 2, 2, 1, 1)
    assert parse_a1("B:C") == (None, None, None, 1, 2)
    assert parse_a1("2:5") == (None, 2, 5, None, None)
    assert parse_a1("Q3 Budget") == ("Q3 Budget", None, None, None, None)
    assert parse_a1("'A1'") == ("A1", None, None, None, None)
    with pytest.raises(ValueError):
        parse_a1("Sheet1!nonsense 1")


def test_tabs_in_order(spark):
    g = grid(spark, [["a"]], [["b"]], names=("Zed", "Alpha"))
    assert [r["tab"] for r in tabs(g).collect()] == ["Zed", "Alpha"]
    assert first_tab(g) == "Zed"
    with pytest.raises(ValueError, match="no first tab"):
        first_tab(g.limit(0))


def test_read_range(spark):
    g = grid(spark, [["a", "b", ""], [], ["", "x", "y"], ["", ""]], [["q"]])
    assert [list(r["cells"]) for r in read_range(g).collect()] == [
        ["a", "b"], [], ["", "x", "y"],
    ]
    assert [list(r["cells"]) for r in read_range(g, "Sheet1!B1:C3").collect()] == [
        ["b"], [], ["x", "y"],
    ]
    assert [list(r["cells"]) for r in read_range(g, "'Q3 Budget'").collect()] == [["q"]]
    assert read_range(g, "Sheet1!Z1:Z9").collect() == []
    with pytest.raises(ValueError):
        read_range(g, "Nowhere!A1")


def test_update_then_read(spark):
    g = grid(spark, [[]], [["other"]])
    done = update_range(g, "Sheet1!A1:B2", values(spark, [["plot", "tree"], ["east", "4"]]))
    assert (done.updated_range, done.updated_cells) == ("'Sheet1'!A1:B2", 4)
    assert cells(done.grid) == [["plot", "tree"], ["east", "4"]]
    assert cells(done.grid, "Q3 Budget") == [["other"]]

    again = update_range(done.grid, "Sheet1!B4", values(spark, [["x", "y"], ["z"]]))
    assert again.updated_range == "'Sheet1'!B4:C5"
    assert cells(again.grid) == [["plot", "tree"], ["east", "4"], [], ["", "x", "y"], ["", "z"]]

    blank = update_range(again.grid, "Sheet1!A1:B2", values(spark, [["", "n"], ["k"]]))
    assert cells(blank.grid)[:2] == [["", "n"], ["k"]]
    with pytest.raises(ValueError, match="fit"):
        update_range(g, "Sheet1!A1:B2", values(spark, [["1", "2", "3"]]))


def test_append_goes_below_the_table(spark):
    g = grid(spark, [["h1", "h2"], ["", ""]])
    done = append_rows(g, "Sheet1!A1", values(spark, [["x", "y"], ["z"]]))
    assert (done.updated_rows, done.updated_range) == (2, "'Sheet1'!A2:B3")
    assert cells(done.grid) == [["h1", "h2"], ["x", "y"], ["z"]]


def test_clear_keeps_the_rows(spark):
    g = grid(spark, [["1", "2", "3"], ["4", "5"]])
    cleared, area = clear_range(g, "Sheet1!B1:C2")
    assert area == "'Sheet1'!B1:C2"
    assert cells(cleared) == [["1"], ["4"]]
    everything, area = clear_range(g, "Sheet1")
    assert (cells(everything), area) == ([[], []], "'Sheet1'")


def test_scattered_edits(spark):
    g = grid(spark, TREES, [["q"]])
    writes = spark.createDataFrame(
        [
            ("'Sheet1'!C2", [["Elstar"]], 1),
            ("Sheet1!C2:D2", [["Jonagold", "7"]], 2),
            ("'Q3 Budget'!AB4", [["far"]], 3),
        ],
        "range string, values array<array<string>>, seq long",
    )
    changed, count = apply_edits(g, parse_edits(writes))
    assert count == 4
    assert cells(changed)[1] == ["north", "16", "Jonagold", "7"]
    assert cells(changed, "Q3 Budget") == [["q"], [], [], [""] * 27 + ["far"]]
    with pytest.raises(ValueError, match="no tab"):
        apply_edits(g, parse_edits(writes.selectExpr("'Nope!A1' AS range", "values", "seq")))


def test_found_rows_agree_with_a_scan(spark):
    g = grid(spark, TREES, [["plot"], ["north"]])
    header = TREES[0]
    full = [dict(zip(header, row + [""] * (len(header) - len(row)))) for row in TREES]
    wanted = [{}, {"plot": "west"}]
    wanted += [{c: row[c]} for c in header for row in full[1:]]
    wanted += [{"plot": row["plot"], "tree": "16"} for row in full[1:]]
    for match in wanted:
        scan = [i + 1 for i, row in enumerate(full) if i and match.items() <= row.items()]
        assert numbers(find_rows(g, match)) == scan, match


def test_headers_that_are_odd(spark):
    nothing = grid(spark, [[], [""]])
    assert numbers(find_rows(nothing, {"plot": "north"})) == []
    with pytest.raises(Refused, match="height") as refusal:
        find_rows(grid(spark, TREES), {"plot": "north", "height": "2"})
    assert refusal.value.status == "unknown_match"
    doubled = grid(spark, [["a", "a"], ["1", "2"]])
    assert numbers(find_rows(doubled, {"a": "2"})) == []
    assert to_table(doubled).columns == ["row_num", "a", "a__2"]
    clashing = grid(spark, [["id", "ID", "row_num", "a", "a", "a__2"], ["1"] * 6])
    names = ["row_num", "id", "ID__2", "row_num__2", "a", "a__3", "a__2"]
    assert to_table(clashing).columns == names
    assert to_table(clashing).count() == 1


def test_one_tab_is_written(spark, tmp_path):
    def lines(**tab):
        out = tmp_path / f"{len(list(tmp_path.iterdir()))}"
        write_grid(two, str(out), **tab)
        return b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))

    two = spark.createDataFrame(
        [("b", 1, 1, ["b1"]), ("a", 0, 1, ["a1"]), ("b", 1, 2, ["b2"]), ("a", 0, 2, ["a2"])],
        "tab string, tab_ord int, row_num long, cells array<string>",
    )
    assert lines() == b"a1\r\na2\r\n"
    assert lines(tab="b") == b"b1\r\nb2\r\n"
    with pytest.raises(ValueError, match="no tab"):
        lines(tab="c")


def test_set_by_match(spark):
    g = grid(spark, TREES, [["q"]])
    done = set_by_match(g, {"tree": "16", "plot": "south"}, {"pruned": "no", "sort": "Topaz"})
    assert (done.rows, done.updated_cells) == (1, 2)
    assert cells(done.grid) == [*TREES[:3], ["south", "16", "Topaz", "", "no"], *TREES[4:]]
    assert cells(done.grid, "Q3 Budget") == [["q"]]
    assert [(r["a1"], r["value"]) for r in done.edits.orderBy("seq").collect()] == [
        ("'Sheet1'!E4", "no"), ("'Sheet1'!C4", "Topaz"),
    ]
    both = set_by_match(g, {"sort": "Rubinette"}, {"crates": "5"}, allow_multiple=True)
    assert (both.rows, both.updated_cells) == (2, 2)
    assert [row[3:4] for row in cells(both.grid)] == [
        ["crates"], ["3"], ["11"], [], ["5"], ["5"],
    ]


def test_one_update_is_refused_as_a_batch_of_it(spark):
    """Every status but ``ok`` is raised, with the status and rows of the batch."""
    asked = [
        (TREES, {"tree": "17"}, {}),
        ([[], []], {"tree": "17"}, {"sort": "Topaz"}),
        (TREES, {"tree": "17"}, {"height": "2"}),
        (TREES, {"height": "2"}, {"sort": "Topaz"}),
        (TREES, {"tree": "17", "plot": "south"}, {"sort": "Topaz"}),
        (TREES, {"sort": "Rubinette", "crates": "4"}, {"pruned": "yes"}),
    ]
    schema = "seq long, match map<string,string>, updates map<string,string>"
    for (rows, match, updates), status in zip(asked, REFUSALS, strict=True):
        g = grid(spark, rows)
        with pytest.raises(Refused) as refusal:
            set_by_match(g, match, updates)
        one = spark.createDataFrame([(1, match, updates)], schema)
        judged = set_by_keys(g, one).results.first()
        assert refusal.value.status == judged["status"] == status
        assert refusal.value.rows == judged["n_rows"]


def test_pairs(spark):
    asked = {
        ("plot=north", "tree=17"): {"plot": "north", "tree": "17"},
        ("note=2 + 2 = 4",): {"note": "2 + 2 = 4"},
        ("\tsort = Cox ",): {"sort": " Cox "},
        ("pruned=no", "tree=3", "pruned=yes"): {"pruned": "yes", "tree": "3"},
        ("crates=",): {"crates": ""},
        (): {},
    }
    refused = {
        ("tree=17", "pruned"): "must be COLUMN=VALUE",
        ("tree=17", " =yes"): "empty column name",
    }
    df = spark.createDataFrame([(list(p),) for p in [*asked, *refused]], "pairs array<string>")
    rows = parse_pairs(df, "pairs", "match").collect()
    assert [r["match"] for r in rows] == [*asked.values(), None, None]
    assert [r["match_error"] for r in rows] == [None] * len(asked) + [*refused.values()]


def test_a_batch_of_keyed_updates(spark):
    g = grid(spark, TREES, [["q"]])
    instructions = spark.createDataFrame(
        [
            (1, {"tree": "17"}, {"sort": "Topaz", "crates": "1"}),
            (2, {"tree": "17"}, {"crates": "2"}),
            (3, {"plot": "north", "pruned": "yes"}, {"crates": "30"}),
            (4, {"plot": "south"}, {"crates": "0"}),
            (5, {"tree": "99"}, {"crates": "0"}),
            (6, {"tree": "17"}, {"height": "2"}),
            (7, {"height": "2"}, {"crates": "0"}),
            (8, {"tree": "17"}, {}),
            (9, {}, {"crates": "0"}),
        ],
        "seq long, match map<string,string>, updates map<string,string>",
    )
    done = set_by_keys(g, instructions)
    assert {r["seq"]: (r["status"], r["n_rows"]) for r in done.results.collect()} == {
        1: ("ok", 1), 2: ("ok", 1), 3: ("ok", 1), 4: ("ambiguous", 3), 5: ("no_match", 0),
        6: ("unknown_target", 0), 7: ("unknown_match", 0), 8: ("no_updates", 0),
        9: ("ambiguous", 5),
    }
    assert cells(done.grid) == [*TREES[:2], ["north", "17", "Topaz", "30", "yes"], *TREES[3:]]
    assert cells(done.grid, "Q3 Budget") == [["q"]]
    assert sorted((r["a1"], r["value"], r["seq"]) for r in done.edits.collect()) == [
        ("'Sheet1'!C3", "Topaz", 1), ("'Sheet1'!D3", "30", 3),
    ]
    everyone = set_by_keys(g, instructions, allow_multiple=True)
    assert [row[3] for row in cells(everyone.grid)] == ["crates"] + ["0"] * 5


def test_typed_cells(spark):
    g = grid(spark, [["12", "1.5", "2026-01-31", "=1+2", "-5", "", "x"]])
    rows = parse_cells(g).orderBy("col_idx").collect()
    assert [(r["as_long"], r["as_double"], str(r["as_date"]), r["formula_risk"]) for r in rows] == [
        (12, 12.0, "None", False), (None, 1.5, "None", False),
        (None, None, "2026-01-31", False), (None, None, "None", True),
        (-5, -5.0, "None", True), (None, None, "None", False),
    ]
    assert all(r["as_long"] is None for r in parse_cells(g, "RAW").collect())


LINES = [
    ["name", "score"], [], ["a,b", 'say "hi"', ""], [""], ["", ""], ["x"] * 5,
    ['"', ""], [" pad ", "\t"],
]


@pytest.mark.parametrize("delimiter", [",", "\t", "|"])
def test_delimited_files_both_ways(spark, tmp_path, delimiter):
    path = tmp_path / "in.csv"
    with path.open("w", newline="") as out:
        csv.writer(out, delimiter=delimiter).writerows(LINES)
    g = read_grid(spark, str(path), delimiter)
    assert cells(g) == LINES
    write_grid(g, str(tmp_path / "out"), delimiter)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == path.read_bytes()


def test_rows_are_numbered_across_splits_and_files(spark, tmp_path):
    expected = []
    for f in range(3):
        rows = [[f"f{f}", str(i), "x" * (i % 90)] for i in range(400 + 100 * f)]
        expected += rows
        with (tmp_path / f"{f}.csv").open("w", newline="") as out:
            csv.writer(out).writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert cells(read_grid(spark, str(tmp_path))) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_quotes_read_as_the_csv_reader_does(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('ab"cd,"ef"gh,"i""j"k"l,",",""\n,x,\n')
    with path.open(newline="") as f:
        assert cells(read_grid(spark, str(path))) == list(csv.reader(f))


def test_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "multi.csv"
    rows = [["a", "two\nlines", "c"], ["d", ""], ["e", "f", 'q"q'], ["g", "h", "i,\nj"]]
    with path.open("w", newline="") as out:
        csv.writer(out).writerows(rows)
    assert cells(read_grid_multiline(spark, str(path), 3)) == rows


def test_a_null_cell_leaves_the_old_value(spark):
    g = grid(spark, [["a", "b", "c"]])
    done = update_range(g, "Sheet1!A1", values(spark, [[None, "x"]]))
    assert cells(done.grid) == [["a", "x", "c"]]
    empty = update_range(g, "Sheet1!A1", values(spark, [["q"]]).limit(0))
    assert (empty.updated_cells, cells(empty.grid)) == (0, [["a", "b", "c"]])


def test_a_refusal_counts_every_match(spark):
    rows = [("S", 0, k, ["k", "v"] if k == 1 else ["same", str(k)]) for k in range(1, 40)]
    g = spark.createDataFrame(rows, "tab string, tab_ord int, row_num long, cells array<string>")
    with pytest.raises(ValueError, match="ambiguous, 38 rows"):
        set_by_match(g, {"k": "same"}, {"v": "x"})


def test_letters_go_on_after_three(spark):
    places = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254]
    df = spark.createDataFrame([(p,) for p in places], "p long")
    got = [r[0] for r in df.select(letter_of(F.col("p"))).collect()]
    assert got == [column_letter(p) for p in places] and got[6] == "AAAA"


def test_edits_reach_rows_that_the_grid_leaves_out(spark):
    g = spark.createDataFrame(
        [("S", 0, 1, ["a"]), ("S", 0, 5, ["e"])],
        "tab string, tab_ord int, row_num long, cells array<string>",
    )
    edits = spark.createDataFrame(
        [("S", 3, 1, "new", 1)], "tab string, row_num long, col_idx int, value string, seq long"
    )
    changed, n = apply_edits(g, edits)
    got = {r.row_num: (r.tab_ord, r.cells) for r in changed.collect()}
    assert n == 1 and got == {1: (0, ["a"]), 3: (0, ["", "new"]), 5: (0, ["e"])}


def test_addresses_past_three_letters_are_read_back():
    for place in (701, 18_277, 18_278, 500_000, 2**31 - 1):
        got = parse_a1(f"Sheet1!{column_letter(place)}4")
        assert (got.tab, got.first_col, got.first_row) == ("Sheet1", place, 4)
        assert parse_a1(got.a1("Sheet1")) == got
    assert parse_a1("Sheet1").tab == "Sheet1"

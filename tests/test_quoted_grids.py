"""Delimited files with line breaks inside cells, at any split size."""

import csv
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgrid.functions.cells import ends_quoted
from leafgrid.sources import grids
from leafgrid.sources.grids import read_grid


def rows_of(seed, n):
    rng = random.Random(seed)
    bits = ["a", "bc", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "x" * 30, "é", ""]
    out = []
    for _ in range(n):
        if rng.random() < 0.1:
            out.append([])
        else:
            out.append(["".join(rng.choices(bits, k=rng.randrange(4))) for _ in range(rng.randint(1, 4))])
    return out


def read_with(spark, path, split, **more):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = read_grid(spark, str(path), **more).orderBy("row_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["row_num"] for r in rows] == list(range(1, len(rows) + 1))
    return [[*r["cells"]] for r in rows]


@pytest.mark.parametrize("split, end", [(150, "\r\n"), (700, "\n"), (10_000_000, "\r\n")])
def test_same_grid_at_every_split_size(spark, tmp_path, split, end):
    """A cell of many lines is longer than the smallest splits."""
    expected = []
    for f in range(2):
        rows = rows_of(f, 25) + [["long", "line\n" * 60 + "end", "z"]] + rows_of(10 + f, 8)
        expected += rows
        with (tmp_path / f"{f}.csv").open("w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=end).writerows(rows)
    assert read_with(spark, tmp_path, split) == expected


def test_odd_quotes_are_read_as_by_the_csv_module(spark, tmp_path):
    rng = random.Random(1)
    expected = []
    for f in range(4):
        text = "".join(rng.choices(['"', '"', "a", "b", ";", ";", "\n", "\n"], k=250)) + "\n"
        path = tmp_path / f"{f}.csv"
        path.write_text(text, newline="")
        with path.open(newline="") as held:
            expected.append(list(csv.reader(held, delimiter=";")))
    # What an open quote at the end of a file means is the reader's own matter.
    got = read_with(spark, tmp_path, 100, delimiter=";")
    for theirs in expected:
        mine, got = got[: len(theirs)], got[len(theirs) :]
        assert mine[:-1] == theirs[:-1]
    assert got == []


def test_an_empty_file_and_an_open_quote(spark, tmp_path):
    (tmp_path / "0.csv").write_text("")
    (tmp_path / "1.csv").write_text('a,"b\nc\n\nd')
    (tmp_path / "2.csv").write_text("e\n")
    got = read_with(spark, tmp_path, 5)
    assert len(got) == 2 and got[1] == ["e"]  # the open quote stops with its file
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "0.csv").write_text("")
    assert read_with(spark, tmp_path / "none", 5) == []


def test_state_is_followed_through_batches():
    rng = np.random.default_rng(3)
    for kinds in ((0.2, 0.2), (0.5, 0.5), (0.9, 0.1)):
        opens, stays = rng.random(60) < kinds[0], rng.random(60) < kinds[1]
        splits = np.repeat([5, 6, 7], [10, 1, 49])
        expected = []
        for split in (5, 6, 7):
            for s in (0, 1):
                state, begun = bool(s), 0
                for n, k in enumerate(np.flatnonzero(splits == split)):
                    after = bool(stays[k] if state else opens[k])
                    begun += not state
                    expected.append((split, s, n, begun, not state and not after, after))
                    state = after
        table = pa.table(
            {
                "value": [""] * 60, "file": ["f"] * 60, "block": splits,
                "opens": opens, "stays": stays, "split": splits,
            }
        )
        for size in (1, 7, 60):
            got = []
            for batch in grids._note_lines(iter(table.to_batches(size))):
                for r in batch.to_pylist():
                    for s in (0, 1):
                        got.append((r["block"], s, r["line"], r[f"row{s}"], r[f"alone{s}"], r[f"ends{s}"]))
            assert sorted(got) == sorted(expected)


def test_lines_that_open_a_cell(spark):
    lines = {
        "": False, '"': True, '""': False, '"""': True, 'a"b': False, 'a,"b': True, 'a,"b"': False,
        'a,"b""': True, '"a"b"': False, '"a,b': True, '"a",b,"': True, '"a" "': False, '",",",': True,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r[0]: r[1] for r in df.select("line", ends_quoted(F.col("line"))).collect()}
    assert got == lines

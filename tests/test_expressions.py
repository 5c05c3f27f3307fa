from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafgrid.functions import catalog, names
from leafgrid.functions.cells import quoted_tab, trim_cells
from leafgrid.plans.queries import QUERIES


def each(spark, values, column, schema="v string"):
    """``column`` of each value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


NAMES = [
    "a.txt", "a.tar.gz", ".env", "file.", "noext", "..foo", "a.b.", "x.PDF", " .x",
    "a. b", "..", "new\nline.md", "é.ñ", "a..b", "tail.x\n",
]


def test_suffix_and_stem_match_path(spark):
    assert each(spark, NAMES, names.suffix(F.col("v"))) == [Path(n).suffix for n in NAMES]
    plain = [n for n in NAMES if n != ".."]
    assert each(spark, plain, names.stem(F.col("v"))) == [Path(n).stem for n in plain]
    paths = ["x.y/z", "x/y.csv", "out.d/", "a/.env"]
    assert each(spark, paths, names.suffix(F.col("v"))) == [Path(n).suffix for n in paths]


def test_safe_names(spark):
    cases = {
        "a/b": "a_b", "a\\b": "a_b", "x\x00y": "x_y", "..": "__", ".": "_", "  ": "file",
        "": "file", ".env": ".env", " pad ": "pad", " x ": "x", "../../e": ".._.._e",
        "in ner": "in ner", "\x1ct\n": "t", "/": "_", " .. ": "__",
    }
    assert each(spark, list(cases), names.safe_filename(F.col("v"))) == list(cases.values())


def test_numbered_names_lead_back(spark):
    n = F.lit(7)
    assert each(spark, ["a.txt", ".env", "a", "x.b (1)"], names.numbered(F.col("v"), n)) == [
        "a (7).txt", ".env (7)", "a (7)", "x (7).b (1)",
    ]
    origins = F.transform(names.copy_origins(F.col("v")), lambda o: F.concat_ws("|", "v", o["base"], o["n"]))
    got = each(spark, ["a (2).txt", "a (02).txt", "b", "c (1)", " (1).txt"], origins)
    assert got == [
        ["a (2).txt|a (2).txt|0", "a (2).txt|a.txt|2"],
        ["a (02).txt|a (02).txt|0"],
        ["b|b|0"],
        ["c (1)|c (1)|0", "c (1)|c|1"],
        [" (1).txt| (1).txt|0"],
    ]


def test_url_suffixes(spark):
    """Links to the service lose their query; one ``/edit``, then one ``/view``, goes."""
    ours = "https://docs.google.com/presentation/d/plum-7"
    cases = {
        f"{ours}/edit": ours,
        f"{ours}/view?resourcekey=0-k": ours,
        f"{ours}?slide=2#end": ours,
        f"{ours}/editor": f"{ours}/editor",
        "http://wiki.orchard.test/pears?rev=3": "http://wiki.orchard.test/pears?rev=3",
        "http://wiki.orchard.test/?see=drive.google.com": "http://wiki.orchard.test/",
        "ftp://orchard.test/view/edit": "ftp://orchard.test",
        "ftp://orchard.test/edit/view": "ftp://orchard.test/edit",
        "ftp://orchard.test/view/view": "ftp://orchard.test/view",
    }
    assert each(spark, list(cases), catalog.strip_url_suffix(F.col("v"))) == list(cases.values())


def test_ids_in_links(spark):
    """An id stands behind ``/d/`` or ``/folders/``, else in ``id=``; text is one."""
    cases = {
        "http://orchard.test/x/d/-plum_7.pdf": "-plum_7",
        "https://orchard.test/u/2/folders/rows-4/d/late": "rows-4",
        "https://orchard.test/d/first?id=second": "first",
        "http://orchard.test/get?part=1&id=q%20r": "q",
        "https://orchard.test/get?id=_&part=1": "_",
        "https://orchard.test/get?uid=7": None,
        "https://orchard.test/folders/": None,
        "http://": None,
        "seven plums": "seven plums",
        "see id: ?id=11": "11",
        " ": " ",
    }
    assert each(spark, list(cases), catalog.extract_id(F.col("v"))) == list(cases.values())


def test_types_and_natives(spark):
    df = spark.createDataFrame(
        [
            ("a", "application/vnd.google-apps.folder"),
            ("a", "application/vnd.google.colaboratory"),
            ("a.PDF", "application/pdf"),
            ("noext", None),
            ("d", "application/vnd.google-apps.unheard"),
        ],
        "name string, mimeType string",
    )
    rows = df.select(catalog.file_type(), catalog.is_native(), catalog.is_folder()).collect()
    assert [tuple(r) for r in rows] == [
        ("folder", True, True), ("colab", False, False), ("PDF", False, False),
        ("unknown", False, False), ("unknown", True, False),
    ]


def test_dates_stay_in_their_offset(spark):
    times = ["2026-03-15T23:30:00-05:00", "2026-03-15T14:30:00.000Z", "", None]
    expected = [datetime.fromisoformat(t).strftime("%Y-%m-%d") if t else "" for t in times]
    assert each(spark, times, catalog.modified_date("v")) == expected
    odd = ["15/03/2026", "2026-03-15", None, "", "2026-99-15T10"]
    assert each(spark, odd, catalog.is_malformed_time("v")) == [True, False, False, False, True]
    assert each(spark, odd, catalog.modified_date("v")) == ["", "2026-03-15", "", "", ""]


def test_sizes_as_text(spark):
    shown = {
        0: "0.0 B", 1023: "1023.0 B", 2**10: "1.0 KB", 1536: "1.5 KB", 2**20 - 1: "1024.0 KB",
        2**20: "1.0 MB", 9 * 2**18: "2.2 MB", 5 * 2**29: "2.5 GB", 2**40: "1.0 TB",
        2**50 - 2**49: "512.0 TB", 3 * 2**50: "3.0 PB", 2**61: "2048.0 PB",
    }
    got = each(spark, list(shown), catalog.format_bytes(F.col("v")), "v long")
    assert got == list(shown.values())


def test_sizes_beyond_a_long_as_text(spark):
    """Exact ties, carries and rests of sizes that no BIGINT holds."""
    sizes = [2**63, 5 * 2**62 + 2**49, 9 * 2**63 + 2**48, 9_000_000 * 2**43, 8_999_937 * 2**43, 2**112]
    shown = [f"{float(n) / 2**50:.1f} PB" for n in sizes]
    wide = F.col("v").cast("decimal(38,0)")
    assert each(spark, [str(n) for n in sizes], catalog.format_bytes(wide), "v string") == shown
    assert each(spark, [float(n) for n in sizes], catalog.format_bytes(F.col("v")), "v double") == shown
    assert each(spark, ["1536", None], catalog.format_bytes(wide), "v string") == ["1.5 KB", None]


def test_sizes_of_large_order_keys(spark, tmp_path):
    keys = [7, 44 * 200_000 - 1, 9_000_001, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    got = QUERIES["q_sizes"](spark, str(tmp_path)).collect()
    assert {r["o_orderkey"]: r["size_text"] for r in got} == {
        7: "896.0 B",
        44 * 200_000 - 1: f"{(44 * 200_000 - 1) / 128:.1f} PB",
        9_000_001: f"{9_000_001 * 2 ** (9_000_001 % 44) / 2**40:.1f} TB",
        None: None,
    }


def test_sizes_from_text(spark):
    texts = ["100", " 7 ", "1_000", "NaN", "12.5", "", None, "+3", "-4", "1__0", "9" * 30]
    assert each(spark, texts, catalog.size_in_bytes("v")) == [
        100, 7, 1000, 0, 0, 0, 0, 3, -4, 0, 0,
    ]


def test_cells_end_at_the_last_filled_one(spark):
    rows = [["a", "", ""], [], [""], [None, "b", None]]
    got = each(spark, rows, trim_cells(F.col("v")), "v array<string>")
    assert got == [["a"], [], [], ["", "b"]]
    assert each(spark, ["it's"], quoted_tab(F.col("v"))) == ["'it''s'"]

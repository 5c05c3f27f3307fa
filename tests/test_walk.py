import pytest
from helpers import DOC, catalog, file, folder
from pyspark.sql import functions as F

from leafgrid.operators.children import child_edges, in_order, list_children, shared_with_me
from leafgrid.operators.walk import listing, walk_tree, walked_folders
from leafgrid.sources.listings import folder_map


def names(df):
    return [r["name"] for r in df.orderBy("sort_key").collect()]


def test_children_come_folders_first_in_any_case(spark):
    files = catalog(
        spark,
        [
            file("1", "b.txt", "r"),
            folder("2", "zeta", "r"),
            file("3", "A.txt", "r"),
            folder("4", "Alpha", "r"),
            file("5", "gone", "r", trashed=True),
            file("6", "team", "r", driveId="D"),
            file("7", "else", "q"),
        ],
    )
    assert [r["name"] for r in in_order(list_children(files, "r")).collect()] == [
        "Alpha", "zeta", "A.txt", "b.txt", "team",
    ]
    user = [r["id"] for r in in_order(list_children(files, "r", "user")).collect()]
    assert user == ["4", "2", "3", "1"]
    with pytest.raises(ValueError):
        list_children(files, "r", "domain")


def test_shared_items_by_name(spark):
    files = catalog(
        spark,
        [
            file("1", "Doc", sharedWithMeTime="2026-01-01T00:00:00Z"),
            file("2", "other", sharedWithMeTime="2026-01-01T00:00:00Z"),
            file("3", "doc"),
            file("4", "doc", sharedWithMeTime="x", trashed=True),
        ],
    )
    assert [r["id"] for r in in_order(shared_with_me(files)).collect()] == ["1", "2"]
    assert [r["id"] for r in shared_with_me(files, "DOC").collect()] == ["1"]


def tree(spark):
    return catalog(
        spark,
        [
            folder("s", "SUB", "r"),
            file("a", "A", "r"),
            file("b", "B", "s"),
        ],
    )


def test_walk_is_depth_first(spark):
    rows = walk_tree(tree(spark), "r").orderBy("sort_key").collect()
    assert [(r["name"], r["ancestors"], r["depth"], r["descended"]) for r in rows] == [
        ("SUB", [], 0, True),
        ("B", ["SUB"], 1, False),
        ("A", [], 0, False),
    ]


@pytest.mark.parametrize("depth", [1, 0, -3])
def test_depth_one_and_below_are_flat(spark, depth):
    rows = walk_tree(tree(spark), "r", depth).orderBy("sort_key").collect()
    assert [(r["name"], r["descended"]) for r in rows] == [("SUB", False), ("A", False)]


def test_depth_two_stops_at_the_second_level(spark):
    files = catalog(
        spark,
        [folder("1", "L1", "r"), folder("2", "L2", "1"), file("3", "deep.pdf", "2")],
    )
    rows = walk_tree(files, "r", 2).orderBy("sort_key").collect()
    assert [(r["name"], r["descended"]) for r in rows] == [("L1", True), ("L2", False)]
    assert names(walk_tree(files, "r")) == ["L1", "L2", "deep.pdf"]


def test_trashed_folders_hide_what_is_below(spark):
    files = catalog(
        spark, [folder("1", "gone", "r", trashed=True), file("2", "x", "1")]
    )
    assert walk_tree(files, "r").isEmpty()


def test_cycles_end_and_two_parents_give_two_rows(spark):
    files = catalog(
        spark,
        [
            folder("1", "one", ["r", "2"]),
            folder("2", "two", "1"),
            file("3", "both", ["1", "2"]),
        ],
    )
    rows = walk_tree(files, "r").orderBy("sort_key").collect()
    assert [(r["id"], r["ancestors"]) for r in rows] == [
        ("1", []), ("2", ["one"]), ("3", ["one", "two"]), ("3", ["one"]),
    ]


def test_a_parent_with_many_subfolders_is_spread(spark):
    rows = [folder(f"f{i}", f"n{i}", "r") for i in range(30)]
    rows += [folder(f"g{i}", "deep", f"f{i}") for i in range(0, 30, 3)]
    files = catalog(spark, rows)
    found, size = walked_folders(child_edges(files), "r", hot_rows=4)
    assert size > 0
    assert found.count() == 41
    assert found.select("folder_id").distinct().count() == 41


def test_walk_agrees_with_recursion_on_a_larger_tree(spark):
    files = spark.range(1, 2000).select(
        F.concat(F.lit("i"), "id").alias("id"),
        F.concat(F.lit("n"), F.pmod(F.col("id") * 7, F.lit(50))).alias("name"),
        F.when(F.col("id") < 300, "application/vnd.google-apps.folder")
        .otherwise("text/plain")
        .alias("mimeType"),
        F.array(F.concat(F.lit("i"), F.floor(F.col("id") / 5).cast("int"))).alias("parents"),
        F.lit(False).alias("trashed"),
    )
    below = {}
    for r in files.collect():
        below.setdefault(r["parents"][0], []).append(r)

    def walk(parent):
        order = lambda r: (r["mimeType"] == "text/plain", r["name"], r["id"])
        for r in sorted(below.get(parent, []), key=order):
            yield r["id"]
            if r["mimeType"] != "text/plain":
                yield from walk(r["id"])

    got = [r["id"] for r in walk_tree(files, "i0").orderBy("sort_key").collect()]
    assert got == list(walk("i0"))


def test_listing_columns_and_map(spark):
    files = catalog(
        spark,
        [
            folder("f", "a/b", "r", modifiedTime="2026-03-15T23:30:00-05:00"),
            file(
                "c", "c.PDF", "f", "application/pdf",
                webViewLink="https://drive.google.com/file/d/c/view?usp=x",
                owners=[("Ada", "ada@x.com")],
                sharingUser=("Bo", "bo@x.com"),
            ),
            file("d", "notes", "r", DOC, owners=[]),
        ],
    )
    rows = listing(files, "r").orderBy("sort_key")
    assert [
        (r["path"], r["file_type"], r["modified"], r["owner"], r["shared_by"], r["depth"])
        for r in rows.collect()
    ] == [
        ("a/b/", "folder", "2026-03-15", "", "", 0),
        ("a/b/c.PDF", "PDF", "", "ada@x.com", "bo@x.com", 1),
        ("notes", "gdoc", "", "", "", 0),
    ]
    assert [r["line"] for r in folder_map(rows).collect()] == [
        "- [a/b](https://drive.google.com/drive/folders/f)",
        "  - [c.PDF](https://drive.google.com/file/d/c)",
        "- [notes](https://drive.google.com/file/d/d)",
    ]


def test_edges_by_parent_give_the_same_results(spark, tmp_path):
    from leafgrid.sources.edges import read_edges, write_edges

    files = catalog(
        spark,
        [
            folder("1", "one", "r"), folder("2", "two", ["1", "r"]), file("3", "x", ["1", "2"]),
            file("4", "gone", "r", trashed=True),
        ],
    )
    write_edges(files, str(tmp_path / "edges"), 3)
    edges = read_edges(spark, str(tmp_path / "edges"))
    same = lambda df: [(r["id"], r["ancestors"]) for r in df.orderBy("sort_key").collect()]
    assert same(walk_tree(edges, "r")) == same(walk_tree(files, "r"))
    ids = lambda df: [r["id"] for r in in_order(df).collect()]
    assert ids(list_children(edges, "r")) == ids(list_children(files, "r")) == ["1", "2"]


def test_folder_and_parent_filters_reach_the_scan(spark, tmp_path, capsys):
    from leafgrid.sources.edges import read_edges, write_edges

    files = catalog(spark, [folder("1", "one", "r"), file("2", "x", "1")])
    write_edges(files, str(tmp_path / "edges"))
    edges = read_edges(spark, str(tmp_path / "edges"))
    list_children(edges, "r").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(parent,r)" in plan and "Not(EqualNullSafe(trashed,true))" in plan


def test_a_large_folder_table_is_not_broadcast(spark, monkeypatch, capsys):
    from leafgrid import skew

    files = catalog(
        spark, [folder("1", "one", "r"), folder("2", "two", "1"), file("3", "x", "2")]
    )
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    walk = walk_tree(files, "r")
    assert names(walk) == ["one", "two", "x"]
    walk.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out

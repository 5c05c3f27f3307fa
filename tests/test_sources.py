import csv
import json
from pathlib import Path

import pytest
from helpers import catalog, file, folder

from leafgrid import scratch, skew
from leafgrid.operators.walk import listing
from leafgrid.schemas import DRIVE_CATALOG, FILE
from leafgrid.sources import snapshot, versions
from leafgrid.sources.drives import load_drives, read_drives, save_drives
from leafgrid.sources.listings import save_listing, write_folder_map
from leafgrid.sources.pages import parse_pages, read_file_pages
from leafgrid.sources.rejects import split_rejects
from leafgrid.sources.snapshot import merge_files, read_snapshot
from leafgrid.streaming.pages import append_new_pages, stream_file_pages, upsert_new_pages


def page(*ids, **more):
    return {"files": [{"id": i, "name": i.upper(), **more} for i in ids]}


def write_pages(folder, **pages):
    folder.mkdir(exist_ok=True)
    for name, body in pages.items():
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1))


def test_pages_become_rows(spark, tmp_path):
    write_pages(
        tmp_path / "p",
        one=page("a", "b", owners=[{"emailAddress": "x@y"}], size="5", unknown=1),
        two={"nextPageToken": "t"},
        three={"files": []},
        four=page("c"),
    )
    rows = sorted(read_file_pages(spark, str(tmp_path / "p"), multi_line=True).collect(), key=lambda r: r["id"])
    assert [(r["id"], r["size"], r["trashed"]) for r in rows] == [
        ("a", "5", None), ("b", "5", None), ("c", None, None),
    ]
    assert rows[0]["owners"][0]["emailAddress"] == "x@y"
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(page("a")) + "\n" + json.dumps(page("b")) + "\n")
    assert read_file_pages(spark, str(lines)).count() == 2
    texts = spark.createDataFrame([(json.dumps(page("z")),), ("{}",)], "json string")
    assert [r["id"] for r in parse_pages(texts, "json").collect()] == ["z"]


def test_new_pages_are_read_once(spark, tmp_path):
    pages, out, mark = (str(tmp_path / n) for n in ("p", "snapshot", "mark"))
    write_pages(tmp_path / "p", one=page("a"))
    for expected in (1, 1, 3):
        if expected == 3:
            write_pages(tmp_path / "p", two=page("b", "c"))
        append_new_pages(stream_file_pages(spark, pages, multi_line=True), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == expected


def test_drive_catalog_round_trip(spark, tmp_path):
    root = spark.createDataFrame([("r",)], "id string")
    shared = spark.createDataFrame([("d1", "Zürich"), ("d0", "A")], "id string, name string").coalesce(1)
    drives = read_drives(root, shared)
    path = str(tmp_path / "drives")
    assert load_drives(spark, path).collect() == []
    save_drives(drives, path)
    assert [tuple(r)[:4] for r in load_drives(spark, path).orderBy("ord").collect()] == [
        ("r", "personal", "My Drive", "https://drive.google.com/drive/my-drive"),
        ("d1", "shared", "Zürich", "https://drive.google.com/drive/folders/d1"),
        ("d0", "shared", "A", "https://drive.google.com/drive/folders/d0"),
    ]


def drive_rows(spark, *names):
    rows = [(n, "shared", n, "u", i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, DRIVE_CATALOG)


def test_a_failed_save_leaves_the_old_catalog(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "drives"
    ids = lambda: sorted(r["id"] for r in load_drives(spark, str(path)).collect())
    save_drives(drive_rows(spark, "a"), str(path))
    reader = load_drives(spark, str(path))
    broken = drive_rows(spark, "b", "c").withColumn("url", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        save_drives(broken, str(path))
    assert ids() == ["a"]
    # A version half written by a lost driver has no mark and is not seen.
    (path / "000000000009-half").mkdir()
    (path / "000000000009-half" / "part-0.json").write_text("{}")
    assert ids() == ["a"]
    save_drives(load_drives(spark, str(path)).union(drive_rows(spark, "d")), str(path))
    assert ids() == ["a", "d"]
    # The version before stays for its readers; older ones go.
    assert reader.count() == 1
    save_drives(drive_rows(spark), str(path))
    assert ids() == [] and len(list((path / "_versions").glob("0*"))) == 2


def records(spark, *rows):
    made = [file(i, n, modifiedTime=t) for i, n, t in rows]
    return catalog(spark, made)


def held(spark, path):
    found = read_snapshot(spark, path).collect()
    return sorted((r["id"], r["name"], r["modifiedTime"]) for r in found)


def test_ids_of_a_drop_are_broadcast_by_their_measured_size(spark, tmp_path, monkeypatch):
    """Files of a few bytes an id must not bring millions of ids to the driver."""
    saved = []
    monkeypatch.setattr(
        snapshot, "save_version",
        lambda df, *where: saved.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, *where),
    )
    save, path = versions.save_version, str(tmp_path / "snapshot")
    drop = records(spark, *[(f"O{k}", "n", None) for k in range(100)])
    merge_files(drop, path)
    for most, joins in ((100 * 60, 0), (100 * 80, 2)):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
        merge_files(drop, path)
        assert saved[-1].count("BroadcastHashJoin") == joins
        assert len(held(spark, path)) == 100


def test_a_snapshot_keeps_the_latest_record_of_an_id(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    assert read_snapshot(spark, path).collect() == []
    first = records(
        spark, ("a", "old", "2024-01-01"), ("a", "new", "2024-02-01"), ("b", "b", None),
        ("c", "c", "2024-01-01"), ("a", "new", "2024-02-01"), (None, "no id", "2024-01-01"),
    )
    merge_files(first, path)
    start = [("a", "new", "2024-02-01"), ("b", "b", None), ("c", "c", "2024-01-01")]
    assert held(spark, path) == start
    merge_files(first, path)
    merge_files(records(spark), path)
    assert held(spark, path) == start
    # Later, at the same time and earlier.
    merge_files(
        records(spark, ("a", "late", "2023-01-01"), ("b", "dated", "2020-01-01"),
                ("c", "renamed", "2024-01-01"), ("d", "d", None)),
        path,
    )
    assert held(spark, path) == [
        ("a", "new", "2024-02-01"), ("b", "dated", "2020-01-01"),
        ("c", "renamed", "2024-01-01"), ("d", "d", None),
    ]


def test_drops_are_merged_once_and_survive_a_failed_merge(spark, tmp_path, monkeypatch):
    from leafgrid.streaming import pages as streaming

    drops, kept, mark = (str(tmp_path / n) for n in ("p", "snapshot", "mark"))

    def run():
        files = stream_file_pages(spark, drops, multi_line=True)
        upsert_new_pages(files, kept, mark).awaitTermination()
        return held(spark, kept)

    write_pages(tmp_path / "p", one=page("a", "b", modifiedTime="2024-01-01"))
    assert run() == [("a", "A", "2024-01-01"), ("b", "B", "2024-01-01")]
    write_pages(tmp_path / "p", two=page("b", "c", modifiedTime="2024-03-01"))

    def merged_then_lost(batch, path):
        merge_files(batch, path)
        raise OSError("lost")

    monkeypatch.setattr(streaming, "merge_files", merged_then_lost)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(streaming, "merge_files", merge_files)
    write_pages(tmp_path / "p", again=page("a", "b", modifiedTime="2024-01-01"))
    assert run() == [
        ("a", "A", "2024-01-01"), ("b", "B", "2024-03-01"), ("c", "C", "2024-03-01"),
    ]


def test_unreadable_records_are_set_apart(spark):
    rows = [
        file("1", "x", modifiedTime="2024-01-31T10:00:00Z", size="12"),
        file("2", "x", modifiedTime="", size=""),
        file("3", "x"),
        file("4", "x", modifiedTime="31.01.2024", size="12 kB"),
        file("5", "x", modifiedTime="2024-02-31T00:00:00Z"),
        file("6", "x", size="1" + "0" * 19),
        file(None, "x", size="1.5"),
    ]
    readable, rejects = split_rejects(catalog(spark, rows))
    assert readable.columns == FILE.names
    assert sorted(r["id"] for r in readable.collect()) == ["1", "2", "3"]
    assert sorted((r["id"] or "", r["field"], r["value"], r["reason"]) for r in rejects.collect()) == [
        ("", "size", "1.5", "no number of bytes"),
        ("4", "modifiedTime", "31.01.2024", "no date"),
        ("4", "size", "12 kB", "no number of bytes"),
        ("5", "modifiedTime", "2024-02-31T00:00:00Z", "no date"),
        ("6", "size", "1" + "0" * 19, "no number of bytes"),
    ]
    readable, rejects = split_rejects(catalog(spark, rows[2:3]))
    assert (readable.count(), rejects.count()) == (1, 0)


def sample(spark):
    return catalog(
        spark,
        [
            folder("f", "dir, with / and \"", "r"),
            file("x", "#one.txt ", "f"),
            file("y", "", "r"),
        ],
    )


def text_of(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))).decode()


def test_one_listing_to_two_sinks(spark, tmp_path):
    rows = listing(sample(spark), "r")
    md, table = tmp_path / "map.md", tmp_path / "data.csv"
    stored = lambda: {str(p) for p in Path(scratch.folder(spark)).rglob("listing-*")}
    before = stored()
    assert save_listing(rows, [str(md), str(table)])
    assert stored() == before
    base = "https://drive.google.com/"
    assert text_of(md) == (
        f'- [dir, with / and "]({base}drive/folders/f)\n'
        f"  - [#one.txt ]({base}file/d/x)\n- []({base}file/d/y)\n"
    )
    text = text_of(table)
    assert text.count("\r\n") == text.count("\n")
    assert text.startswith("path,name,type,") and text.count("path,name,") == 1
    read = list(csv.DictReader(text.splitlines()))
    assert list(read[0]) == ["path", "name", "type", "modified", "owner", "shared_by", "url"]
    assert [(r["path"], r["name"], r["type"]) for r in read] == [
        ('dir, with / and "', 'dir, with / and "', "folder"),
        ('dir, with / and "/#one.txt ', "#one.txt ", "txt "),
        ("", "", "unknown"),
    ]


def test_nothing_is_written_for_an_empty_listing(spark, tmp_path):
    rows = listing(sample(spark), "nowhere")
    assert not save_listing(rows, [str(tmp_path / "a.md")])
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="use .md or .csv"):
        save_listing(rows, [str(tmp_path / "a.md"), str(tmp_path / "b.txt")])


def test_a_long_map_keeps_walk_order(spark, tmp_path):
    files = catalog(spark, [file(f"{i:04}", f"n{i:04}", "r") for i in range(500)])
    write_folder_map(listing(files, "r"), str(tmp_path / "m"))
    lines = text_of(tmp_path / "m").splitlines()
    assert len(lines) == 500 and lines == sorted(lines)

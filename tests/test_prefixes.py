"""Path prefixes: drives by name length, and the trie against a walk per path."""

import random
from collections import Counter, defaultdict

import pytest
from helpers import catalog, file, folder
from pyspark.sql import functions as F

from leafgrid.operators import resolve
from leafgrid.operators.lookup import match_drive_prefix, stored_index
from leafgrid.operators.resolve import path_heads, prefix_trie, resolve_paths
from leafgrid.schemas import DRIVE_CATALOG

DRIVES = [("root", "My Drive"), ("d1", "Team"), ("d2", "Team/Ops/Now"), ("d3", "TEAM"), ("d4", "team/x")]


@pytest.fixture(scope="module")
def drives(spark):
    rows = [(id, "shared", name, "", i) for i, (id, name) in enumerate(DRIVES)]
    return spark.createDataFrame(rows, DRIVE_CATALOG)


def random_tree(seed):
    rng = random.Random(seed)
    rows, folders = [], ["root", "d1", "d2"]
    for k in range(160):
        parent = rng.choice(folders[-25:] + folders[:6])
        name = rng.choice(["a", "B", "b", "Café", "x y", ""]) + rng.choice(["", "", "1", "2", "3"])
        if rng.random() < 0.75:
            rows.append(folder(f"f{k}", name, parent))
            folders.append(f"f{k}")
        else:
            rows.append(file(f"t{k}", name, parent))
    rows.append(folder("slash", "a/1", "root"))  # a name that no segment can be
    deep = "root"
    for k in range(11):  # a chain far longer than one round
        rows.append(folder(f"deep{k}", f"Level{k}", deep))
        deep = f"deep{k}"
    return rows


def random_paths(rows, seed):
    rng = random.Random(seed)
    name_of = {r["id"]: (r["name"], r["parents"][0]) for r in rows}
    drive_of = {"root": "my drive", "d1": "team", "d2": "TEAM/ops/Now"}
    paths = ["", "/", None, "Team", "who/a", "my drive//", "Team/Ops", "my drive/Level0/level1/none/" + "x/" * 40]
    for id in name_of:
        parts, at = [], id
        while at in name_of:
            parts.append(name_of[at][0])
            at = name_of[at][1]
        parts = parts[::-1]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["none", "a", "b"]))
        text = "/".join([drive_of[at], *parts])
        paths.append(rng.choice([text, text.upper(), "/" + text + "/"]))
    return paths + paths[5:25]


def plain(path, rows, allow_files):
    first = {}
    for id, name in DRIVES:
        first.setdefault(name.lower(), id)
    parts = path.strip("/").split("/")
    at = rest = None
    for n in range(len(parts), 0, -1):
        if "/".join(parts[:n]).lower() in first:
            at, rest = first["/".join(parts[:n]).lower()], parts[n:]
            break
    if at is None:
        return None, "no_drive", parts[0], "drive", None
    for k, name in enumerate(rest):
        files = allow_files and k == len(rest) - 1
        found = [
            r["id"]
            for r in rows
            if r["parents"] == [at]
            and r["name"].lower() == name.lower()
            and (files or r["mimeType"].endswith(".folder"))
        ]
        kind = "file or folder" if files else "folder"
        if not found:
            return None, "not_found", name, kind, at
        if len(found) > 1:
            return None, "ambiguous", name, kind, at
        at = found[0]
    return at, "ok", None, None, None


@pytest.mark.parametrize("allow_files", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_walk_per_path(spark, drives, seed, allow_files):
    rows = random_tree(seed)
    texts = random_paths(rows, seed)
    # Columns of a request may have the names of the trie's own.
    requests = spark.createDataFrame(
        [(t, k, "s") for k, t in enumerate(texts)], "path string, number int, start string"
    )
    got = resolve_paths(requests, catalog(spark, rows), drives, allow_files)
    result = {r["number"]: r for r in got.collect()}
    assert len(result) == len(texts) and got.columns[:3] == requests.columns
    statuses = Counter()
    for k, text in enumerate(texts):
        r = result[k]
        if text is None:
            assert (r["id"], r["status"], r["segment"]) == (None, "no_drive", None)
            continue
        expected = plain(text, rows, allow_files)
        assert (r["id"], r["status"], r["segment"], r["kind"], r["at_folder"]) == expected, text
        statuses[r["status"]] += 1
    assert min(statuses[s] for s in ("ok", "no_drive", "not_found", "ambiguous")) >= 1


def test_each_prefix_is_looked_up_once(spark, monkeypatch):
    """A hundred paths below one folder look their common names up once."""
    heads = spark.createDataFrame(
        [("root", ["A", "b", f"n{k % 50}", "end"][: 3 + k % 2]) for k in range(100)]
        + [("root", ["none", "b", "c", "d"])],
        "at_folder string, rest array<string>",
    )
    index = spark.createDataFrame(
        [("root", "a", 1, 1, "A"), ("A", "b", 1, 1, "B")]
        + [("B", f"n{k}", 1, 1, f"N{k}") for k in range(0, 50, 2)],
        "parent string, lname string, folders long, items long, folder_child string",
    ).withColumn("item_child", F.col("folder_child"))
    asked = []
    look_up = resolve._look_up

    def counted(prefixes, name, depth, names):
        asked.append(prefixes.count())
        return look_up(prefixes, name, depth, names)

    monkeypatch.setattr(resolve, "_look_up", counted)
    trie = prefix_trie(path_heads(heads).distinct(), index).collect()
    distinct = defaultdict(set)
    for r in heads.collect():
        padded = [s.lower() for s in r["rest"]] + ["/"] * 4
        for k in range(1, 5):
            distinct[k].add(tuple(padded[:k]))
    assert asked == [len(distinct[k]) for k in range(1, 5)] == [2, 2, 51, 51]
    assert {r["last"]["depth"] for r in trie if r["name1"] == "none"} == {1}


def test_prefixes_have_lengths_of_drive_names(spark, drives):
    _, _, lengths = stored_index(drives)
    assert lengths == [1, 2, 3]
    paths = spark.createDataFrame(
        [("team/OPS/now/z",), ("Team/ops",), ("TEAM/X",), ("team/x/" + "y/" * 200,), ("none/x",), ("",)],
        "path string",
    )
    got = {r["path"]: (r["drive_id"], len(r["rest"] or [])) for r in match_drive_prefix(paths, drives).collect()}
    assert got == {
        "team/OPS/now/z": ("d2", 1), "Team/ops": ("d1", 1), "TEAM/X": ("d4", 0),
        "team/x/" + "y/" * 200: ("d4", 200), "none/x": (None, 0), "": (None, 0),
    }
    none = match_drive_prefix(paths, drives.filter("false")).collect()
    assert len(none) == 6 and all(r["drive_id"] is None and r["rest"] is None for r in none)
    only_short = drives.filter("not contains(name, '/')")
    plan = match_drive_prefix(paths, only_short)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # one length, one join

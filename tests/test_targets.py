import random
from pathlib import PurePosixPath

import pytest
from helpers import DOC, catalog, file, folder
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.operators.targets import allocate_targets
from leafgrid.operators.transfer import path_conflicts, transfer_manifest
from leafgrid.operators.walk import walk_tree
from leafgrid.skew import prefix_sum


def allocated(spark, rows, root="r", out=".", existing=None, hot_rows=1_000_000):
    manifest = scratch.store(
        transfer_manifest(walk_tree(catalog(spark, rows), root), out), "manifest"
    )
    if existing is not None:
        existing = spark.createDataFrame(existing, "path string, is_dir boolean")
    return allocate_targets(manifest, existing, hot_rows)


def by_turn(rows):
    """The rule taken literally: one file after the other, first free name."""
    taken, targets = {"."}, []
    for r in rows:
        if r["action"] == "mkdir":
            taken.add(str(PurePosixPath(r["dir"]) / r["base"]))
        if r["action"] not in ("binary", "export"):
            continue
        wanted = PurePosixPath(r["dir"]) / r["base"]
        path, n = wanted, 0
        while str(path) in taken:
            n += 1
            path = wanted.with_name(f"{wanted.stem} ({n}){wanted.suffix}")
        taken.add(str(path))
        targets.append((r["id"], str(path)))
    return targets


def result(targets):
    rows = targets.orderBy("sort_key").collect()
    return [(r["id"], r["target"]) for r in rows if r["target"] is not None]


def test_repeated_names_are_numbered_in_walk_order(spark):
    rows = [file(f"i{k}", "cv.pdf", "r") for k in range(3)]
    rows += [file("x", "other.pdf", "r"), file("d", "cv", "r", DOC), file("e", "cv", "r", DOC)]
    assert dict(result(allocated(spark, rows, out="out/"))) == {
        "i0": "out/cv.pdf", "i1": "out/cv (1).pdf", "i2": "out/cv (2).pdf",
        "x": "out/other.pdf", "d": "out/cv.docx", "e": "out/cv (1).docx",
    }


def test_real_names_that_look_numbered(spark):
    rows = [
        file("1", "a", "r", DOC), file("2", "a", "r", DOC), file("3", "a", "r", DOC),
        file("4", "a (1).docx", "r"), file("5", "a (1) (1).docx", "r"),
    ]
    targets = allocated(spark, rows)
    assert result(targets) == by_turn(targets.orderBy("sort_key").collect())


def test_folders_and_present_paths_take_names(spark):
    rows = [folder("f", "x.txt", "r"), file("1", "x.txt", "r"), file("2", "y", "r")]
    existing = [("out/y", False), ("out/y (1)", True), ("elsewhere/y (2)", False)]
    got = dict(result(allocated(spark, rows, out="out", existing=existing)))
    assert got == {"1": "out/x (1).txt", "2": "out/y (2)"}


def test_folders_that_become_one_directory_share_names(spark):
    rows = [
        folder("f", "a/b", "r"), folder("g", "a_b", "r"),
        file("1", "n.txt", "f"), file("2", "n.txt", "g"),
    ]
    assert dict(result(allocated(spark, rows))) == {
        "1": "a_b/n.txt", "2": "a_b/n (1).txt",
    }


def test_a_folder_that_finds_a_file_in_its_place_is_a_conflict(spark):
    rows = [
        folder("f", "same", "r"), folder("g", "same", "r"),
        file("1", "x", "f"), folder("2", "x", "g"),
    ]
    targets = allocated(spark, rows)
    assert [r["path"] for r in path_conflicts(targets).collect()] == ["same/x"]
    present = spark.createDataFrame(
        [("same", False), ("same/x", True)], "path string, is_dir boolean"
    )
    got = {r["path"] for r in path_conflicts(targets, present).collect()}
    assert got == {"same", "same/x"}
    for spelled in ("./same", "same/", "./same//"):
        present = spark.createDataFrame([(spelled, False)], "path string, is_dir boolean")
        got = {r["path"] for r in path_conflicts(targets, present).collect()}
        assert got == {"same", "same/x"}


def test_the_output_folder_is_checked_without_targets(spark):
    targets = allocated(spark, [file("1", "x", "elsewhere")])
    present = spark.createDataFrame([("./out", False)], "path string, is_dir boolean")
    assert targets.count() == 0
    assert path_conflicts(targets, present).count() == 0
    assert [r["path"] for r in path_conflicts(targets, present, "out/").collect()] == ["out"]


NAMES = [
    "a.txt", "a (1).txt", "a (2).txt", "a (1) (1).txt", "A.txt", "a (01).txt",
    "a", "a (1)", "a (2)", ".env", ".env (1)", "a.", "a. (1)", "a (1). (1)",
    "a (1).", "a.b (1)", "a (1).b (1)", "a.b", "a (1).b", "a (1).b (2)", " (1).txt",
]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_random_directories_match_the_rule(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        pool = rng.sample(NAMES, rng.randint(2, len(NAMES)))
        rows.append(folder(f"d{k}", f"dir{k}", "r"))
        # Folders of one name merge, so their files take turns out of name order.
        for twin in range(3):
            rows.append(folder(f"d{k}{twin}", "twin", f"d{k}"))
            for i in range(rng.randint(1, 9)):
                name = rng.choice(pool)
                mime = rng.choice(["text/plain", "text/plain", DOC])
                rows.append(file(f"{k}{twin}{i}", name, f"d{k}{twin}", mime))
        rows.append(folder(f"s{k}", rng.choice(pool), f"d{k}1"))
    present = [(f"dir{k}/twin/{rng.choice(NAMES)}", False) for k in range(3)]
    manifest_rows = allocated(spark, rows, existing=present, hot_rows=hot_rows)
    ordered = manifest_rows.orderBy("sort_key").collect()
    start = [{"action": "mkdir", "dir": p.rsplit("/", 1)[0], "base": p.rsplit("/", 1)[1]}
             for p, _ in present]
    expected = by_turn(start + [r.asDict() for r in ordered])
    assert result(manifest_rows) == expected


def test_prefix_sums_agree_whether_spread_or_not(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.xxhash64("id").alias("o"),
        (F.col("id") % 5).alias("v"),
    )
    plain = prefix_sum(df, ["k"], ["o"], F.col("v"), "s", False)
    spread = prefix_sum(df, ["k"], ["o"], F.col("v"), "s", True, rows_per_part=20)
    key = lambda r: (r["k"], r["o"])
    assert sorted(plain.collect(), key=key) == sorted(spread.select(plain.columns).collect(), key=key)


def test_prefix_sums_of_null_keys(spark):
    """A group without a key that runs over many partitions keeps its carry."""
    df = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, F.lit("k")).alias("k"), F.lit(None).cast("int").alias("j"), "id"
    )
    got = prefix_sum(df, ["k", "j"], ["id"], F.lit(1), "s", True, rows_per_part=10, rows=300)
    assert got.columns == ["k", "j", "id", "s"]
    sums = {(r["k"], r["id"]): r["s"] for r in got.collect()}
    for name, ids in ((None, range(0, 300, 3)), ("k", [i for i in range(300) if i % 3])):
        assert [sums[name, i] for i in ids] == list(range(len(ids)))


def test_jobs_do_not_grow_with_a_chain_of_names(spark):
    """Each name pushes the next one: rounds would take a turn for each."""
    counts = []
    for length in (4, 8, 16):
        rows = [file("0", "a", "r"), file("1", "a", "r")]
        rows += [file(f"n{k:02}", "a" + " (1)" * k, "r") for k in range(1, length)]
        manifest = scratch.store(
            transfer_manifest(walk_tree(catalog(spark, rows), "r"), "."), "manifest"
        )
        group = f"chain of {length}"
        spark.sparkContext.setJobGroup(group, "")
        targets = allocate_targets(manifest)
        got = result(targets)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext._jsc.sc().clearJobGroup()
        assert got == by_turn(targets.orderBy("sort_key").collect())
        assert dict(got)[f"n{length - 1:02}"] == "a" + " (1)" * length
    assert len(set(counts)) == 1


def test_hot_and_small_families_side_by_side(spark):
    """One family goes by rounds, the others by one pass, repeated and mixed alike."""
    rows = [file(f"h{k:02}", ["hot", "hot (1)", "hot (3)"][k % 3], "r") for k in range(30)]
    rows += [file(f"s{k}", ["b.txt", "b (1).txt"][k % 2], "r") for k in range(6)]
    rows += [file(f"r{k}", "same.txt", "r") for k in range(5)]
    rows += [file(f"q{k:02}", "many.txt", "r") for k in range(20)]
    rows += [folder("f", "b (2).txt", "r"), file("one", "one", "r")]
    small = allocated(spark, rows, hot_rows=10)
    expected = by_turn(small.orderBy("sort_key").collect())
    assert result(small) == expected == result(allocated(spark, rows))


def test_families_that_run_over_batches(spark):
    """The names of a family are known beyond the Arrow batch they came in."""
    from leafgrid.operators.targets import _number_files
    import pyarrow as pa

    names = ["a", "a", "a (1)", "a", "a (1)", "a (2)", "a"]
    held = [False, True, True, True, True, False, True]
    table = pa.table(
        {
            "dir": ["d"] * 7 + ["e"] * 7, "family": ["a"] * 14, "base": names * 2,
            "stem": names * 2, "suffix": [""] * 14, "is_file": held * 2,
        }
    )
    for rows in (1, 3, 14):
        out = [n for b in _number_files(iter(table.to_batches(rows))) for n in b["n"].to_pylist()]
        assert out == [None, 1, 1, 2, 2, None, 3] * 2


def test_a_chain_of_pushed_names_takes_several_rounds(spark):
    rows = [file("0", "a", "r"), file("1", "a", "r")]
    rows += [file(str(k), "a" + " (1)" * (k - 1), "r") for k in range(2, 7)]
    rows += [file("x", "b", "r"), file("y", "b", "r"), file("z", "b (1)", "r")]
    targets = allocated(spark, rows)
    got = result(targets)
    assert got == by_turn(targets.orderBy("sort_key").collect())
    assert dict(got)["6"] == "a" + " (1)" * 6

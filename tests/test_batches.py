"""Keyed batches: any number of kinds of keys in the same jobs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from leafgrid.operators.keyed import KEY, facts_of, set_by_keys, set_by_match

HEAD = ["plot", "tree", "sort", "crates", "plot"]  # a repeated name means its first column
SCHEMA = "seq long, match map<string,string>, updates map<string,string>"


def orchard(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [HEAD] + [
        [rng.choice(["north", "south", ""]), str(rng.randrange(n)), rng.choice(["Cox", "Topaz"])][: rng.randint(1, 3)]
        for _ in range(n)
    ]
    rows[10] = []
    table = [("Sheet1", 0, k + 1, r) for k, r in enumerate(rows)] + [("Other", 1, 1, ["q"]), ("Sheet1", 0, n + 2, ["", ""])]
    return spark.createDataFrame(table, "tab string, tab_ord int, row_num long, cells array<string>"), rows


def plain(rows, asked, allow_multiple):
    results, latest = {}, {}
    place = {name: k for k, name in reversed(list(enumerate(HEAD)))}
    for seq, match, updates in asked:
        hit = []
        if not updates:
            status = "no_updates"
        elif not set(updates) <= set(HEAD):
            status = "unknown_target"
        elif not set(match) <= set(HEAD):
            status = "unknown_match"
        else:
            for n, row in enumerate(rows[1:], 2):
                padded = row + [""] * 5
                if all(padded[place[c]] == v for c, v in match.items()):
                    hit.append(n)
            status = "ok" if len(hit) == 1 or (hit and allow_multiple) else "ambiguous" if hit else "no_match"
        results[seq] = (status, len(hit))
        if status == "ok":
            for n in hit:
                for c, v in updates.items():
                    latest[n, place[c]] = max(latest.get((n, place[c]), (seq, v)), (seq, v))
    out = []
    for n, row in enumerate(rows, 1):
        row = row + [""] * 5
        for (m, k), (_, v) in latest.items():
            if m == n:
                row[k] = v
        while row and row[-1] == "":
            row.pop()
        out.append(row)
    return results, out, {(m, k): (v, seq) for (m, k), (seq, v) in latest.items()}


def instructions(n, seed):
    rng = random.Random(seed)
    columns = ["plot", "tree", "sort", "crates"]
    asked = []
    for seq in range(n):
        on = rng.sample(columns, rng.randrange(0, 4)) + (["height"] if rng.random() < 0.05 else [])
        value = {"plot": ["north", "south", ""], "sort": ["Cox", "Topaz", ""], "crates": ["", "7"]}
        match = {c: rng.choice(value.get(c, [str(rng.randrange(60))])) for c in on}
        targets = rng.sample(columns + ["weight"], rng.choice([0, 1, 1, 2]))
        asked.append((seq, match, {c: rng.choice(["", "x", "new"]) for c in targets}))
    return asked + [(n, {"tree": None}, {"sort": "x"})]


@pytest.mark.parametrize("allow_multiple", [False, True])
def test_batch_equals_one_at_a_time(spark, allow_multiple):
    g, rows = orchard(spark)
    asked = instructions(150, 3)
    done = set_by_keys(g, spark.createDataFrame(asked, SCHEMA), allow_multiple=allow_multiple)
    results, changed, latest = plain(rows, asked[:-1], allow_multiple)
    got = {r["seq"]: (r["status"], r["n_rows"]) for r in done.results.collect()}
    assert got.pop(150) == ("no_match", 0)  # a null value meets no cell
    assert got == results
    sheet = done.grid.filter("tab = 'Sheet1' and row_num <= 61").orderBy("row_num").collect()
    assert [[*r["cells"]] for r in sheet] == changed
    edits = {(r["row_num"], r["col_idx"]): (r["value"], r["seq"]) for r in done.edits.collect()}
    assert edits == latest
    assert done.grid.count() == g.count()


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    run()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("other", "")
    return len(jobs)


def test_jobs_do_not_depend_on_the_kinds_of_keys(spark):
    g, _ = orchard(spark)
    columns = ["plot", "tree", "sort", "crates"]
    kinds = [c for n in (1, 2, 3) for c in combinations(columns, n)][:10]
    counts = []
    for some in (kinds[:1], kinds):
        asked = [(k, {c: "north" for c in on}, {"crates": "1"}) for k, on in enumerate(some)]
        df = spark.createDataFrame(asked, SCHEMA).coalesce(1)
        spark.sparkContext.setJobGroup("counted", "")
        counts.append(jobs_of(spark, lambda: set_by_keys(g, df)))
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert counts[1] - counts[0] == counts[0]  # the group's jobs add up


def test_a_hot_key_of_rows_and_instructions(spark):
    """A third of the rows and of the instructions share one key."""
    rows = [HEAD] + [["north" if k % 3 else "south", str(k)] for k in range(300)]
    g = spark.createDataFrame(
        [("Sheet1", 0, k + 1, r) for k, r in enumerate(rows)],
        "tab string, tab_ord int, row_num long, cells array<string>",
    )
    asked = [(k, {"plot": "south"}, {"sort": str(k)}) for k in range(100)]
    asked += [(100 + k, {"tree": str(k)}, {"crates": "c"}) for k in range(200)]
    done = set_by_keys(g, spark.createDataFrame(asked, SCHEMA), allow_multiple=True)
    assert done.results.filter("status <> 'ok'").count() == 0
    assert {r["n_rows"] for r in done.results.filter("seq < 100").collect()} == {100}
    changed = {r["row_num"]: r["cells"] for r in done.grid.collect()}
    assert all(changed[k + 2][2] == "99" for k in range(0, 300, 3))
    assert done.edits.groupBy(F.col("col_idx")).count().orderBy("col_idx").collect() == [(2, 100), (3, 200)]


def test_facts_take_one_look(spark):
    g, rows = orchard(spark)
    assert facts_of(g) == ("Sheet1", HEAD, max(k for k, r in enumerate(rows, 1) if any(r)))
    assert facts_of(g, "Other") == ("Other", ["q"], 1)
    with pytest.raises(ValueError, match="no tab named"):
        facts_of(g, "None")
    empty = g.filter("tab = 'Other'").withColumn("cells", F.array(F.lit("")))
    assert facts_of(empty) == ("Other", None, None)
    spark.sparkContext.setJobGroup("one", "")
    set_by_match(g.filter("row_num < 4"), {"tree": rows[1][1] if len(rows[1]) > 1 else ""}, {"sort": "z"}, allow_multiple=True)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one"))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs <= 4 and KEY == ["kind", "key"]

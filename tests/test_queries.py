"""Every registered query against its SQL twin at the smallest scale."""

import os
from pathlib import PurePosixPath

import pytest

from __spark_entry__ import queries
from leafgrid.plans import queries as registered
from leafgrid.plans.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders documents pages lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(cleaned, key=repr)


def _plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    expected = comparable([d[0] for d in result.description], result.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(ORACLES)


def test_mixed_targets_follow_the_walk(spark, monkeypatch):
    seen = {}
    allocate = registered.targets.allocate_targets

    def keep(manifest, existing):
        seen.update(manifest=manifest, existing=existing)
        return allocate(manifest, existing)

    monkeypatch.setattr(registered.targets, "allocate_targets", keep)
    rows = queries()["q_targets_mixed"](spark, SF_DIR).collect()
    got = sorted((r["id"], r["target"]) for r in rows if r["target"])
    taken = {r["path"] for r in seen["existing"].collect()}
    expected = []
    for r in seen["manifest"].orderBy("sort_key").collect():
        wanted = PurePosixPath(r["dir"]) / r["base"]
        if r["action"] == "mkdir":
            taken.add(str(wanted))
        elif r["action"] in ("binary", "export"):
            path, n = wanted, 0
            while str(path) in taken:
                n += 1
                path = wanted.with_name(f"{wanted.stem} ({n}){wanted.suffix}")
            taken.add(str(path))
            expected.append((r["id"], str(path)))
    assert got == sorted(expected)

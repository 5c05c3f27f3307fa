import os

import pytest
from pyspark.sql import functions as F

from leafgrid import scratch


def test_stored_tables_are_read_back_and_cleared(spark):
    df = spark.range(100).select("id", F.array(F.lit("x")).alias("a"))
    table = scratch.store(df, "t")
    assert table.schema.simpleString() == df.schema.simpleString()
    again, seen = scratch.measure(df, "t", rows=F.count(F.lit(1)), top=F.max("id"))
    assert (again.count(), seen) == (100, {"rows": 100, "top": 99})
    _, none = scratch.measure(df.filter("id < 0"), "t", rows=F.count(F.lit(1)))
    assert none == {"rows": 0}
    home = f"{scratch.folder(spark)}/{spark.sparkContext.applicationId}"
    assert os.path.isdir(home)
    scratch.clear(spark)
    assert not os.path.exists(home)


def test_a_scope_deletes_what_was_stored_inside(spark):
    home = f"{scratch.folder(spark)}/{spark.sparkContext.applicationId}"
    kept = scratch.store(spark.range(3), "kept")
    before = sorted(os.listdir(home))
    with pytest.raises(ZeroDivisionError):
        with scratch.scope(spark):
            assert scratch.store(spark.range(4), "outer").count() == 4
            with scratch.scope(spark):
                scratch.store(spark.range(5), "inner")
            assert sorted(os.listdir(home)) != before
            1 / 0
    assert sorted(os.listdir(home)) == before and kept.count() == 3


class Unset:
    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Unset("yarn"))
    monkeypatch.setattr(scratch, "_local_folder", None)
    assert scratch.folder(Unset("local[2]")) == scratch.folder(Unset("local[2]"))

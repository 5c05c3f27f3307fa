"""The pipeline's stages and the registered queries on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from leafgrid import scratch, skew
from leafgrid.llm.common import read_table, word_count
from leafgrid.llm.mixing import mix_sources, taken_words
from leafgrid.llm.queries import ORACLES
from leafgrid.scratch import store

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries()[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_stages_keep_the_columns_and_odd_rows(spark):
    docs = read_table(spark, SF_DIR, "documents")
    odd = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "odd words of mine here", "en", None, 5),
         (-3, "again and again it is said", "en", "s", 1), (-3, "again and again it is said", "en", "s", 1)],
        docs.schema,
    )
    rows = store(docs.union(odd), "odd")
    for name, stage in corpus_pipeline.STAGES:
        before = rows.count()
        rows = store(stage(spark, rows, SF_DIR), "stage")
        if name != "BPE encoding":
            assert rows.columns == docs.columns and 0 < rows.count()
            if name != "mixing sources":
                assert rows.count() <= before
                assert rows.select("doc_id").subtract(docs.union(odd).select("doc_id")).count() == 0
        assert stage(spark, docs.filter("false"), SF_DIR).count() == 0
    assert rows.filter("n_tokens > 0").count() > 0


def test_mixing_writes_the_words_of_repeated_rows(spark):
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text(1, 40), "en", "a", 1)] * 6 + [(k, text(k, 40), "en", "a", 1) for k in range(2, 5)]
    rows += [(None, text(9, 30), "en", None, 1)] * 3 + [(k, text(k, 90), "en", "b", 1) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = mix_sources(docs).groupBy("source").agg(F.sum(taken_words()).alias("n")).collect()
    got = corpus_pipeline.mix_stage(spark, docs, SF_DIR).groupBy("source").agg(F.sum(word_count("text")).alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))


def _stored_bytes(spark) -> int:
    home = f"{scratch.folder(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(home) for f in names)


def test_mixing_stores_the_texts_once(spark):
    rng = random.Random(4)
    rows = [(k, rng.randbytes(4000).hex(" ", 4), "en", "ab"[k % 2], 1) for k in range(300)]
    rows += rows[:20]
    docs = store(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "texts")
    before = _stored_bytes(spark)
    plan = corpus_pipeline.mix_stage(spark, docs, SF_DIR)
    assert _stored_bytes(spark) - before < 1.5 * sum(len(r[1]) for r in rows)
    assert plan.count() >= 1


@pytest.mark.parametrize("limit", [0, skew.BROADCAST_BYTES])
def test_mixing_tells_repeated_rows_apart_by_any_join(spark, monkeypatch, limit):
    """Rows of equal doc_id, text and source are numbered from 0, whatever else they hold."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    seen = []
    monkeypatch.setattr(corpus_pipeline, "mix_sources", lambda d: seen.append(d) or mix_sources(d))
    rows = [(k % 3 or None, f"some words {k % 3}", lang, None, 1) for k in range(9) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_stage(spark, docs.repartition(4), SF_DIR)
    keys = [r.doc_id.rsplit("-", 1) for r in seen[0].select("doc_id").collect()]
    assert sorted(int(n) for _, n in keys) == sorted([*range(6)] * 3)
    assert len({h for h, _ in keys}) == 3
    # One source: the mix takes every word once.
    assert got.agg(F.sum(word_count("text"))).first()[0] == 3 * len(rows)

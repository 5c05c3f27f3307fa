"""Connected components of a link table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.scratch import measure, store


def components(links: DataFrame) -> DataFrame:
    """For each node of ``links`` (a, b) its component: the smallest node in reach.

    Large-star and small-star steps in turn: a node's larger neighbours, then its
    smaller ones, are linked with the smallest node around it, until nothing
    changes and every node is linked with the smallest of its component. Minima
    are combined before shuffling and written, so that the joins with them split
    a node with very many links. Gives (node, component) for linked nodes.
    """
    edges, seen = _written(
        links.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
    )
    while True:
        both = edges.union(edges.select("b", "a"))
        low = store(_lowest(both), "lowest")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), "low")
        large = store(large.withColumnRenamed("low", "b").distinct(), "large")
        low = store(_lowest(large), "lowest")
        small = large.join(low, "a").filter("b <> low").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
        last = seen
        edges, seen = _written(small.union(low.select("a", "low")))
        if seen == last:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())


def _lowest(edges: DataFrame) -> DataFrame:
    low = F.least(F.min("b"), F.col("a"))
    return edges.groupBy("a").agg(low.alias("low"))


def _written(edges: DataFrame):
    """The distinct edges as a table, and a digest that tells if they changed."""
    mark = F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1)
    table = store(edges.distinct(), "edges")
    digest = table.agg(
        F.count(F.lit(1)).alias("n"), F.sum(mark).alias("h"), F.bit_xor(mark).alias("x")
    ).first()
    return table, digest

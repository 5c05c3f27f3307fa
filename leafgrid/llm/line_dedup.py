"""Line dedup over a suffix array of line ids, built by prefix doubling.

Every line that has a word is a symbol, its 128-bit hash; a document is a
sequence of symbols. A symbol seen once can be in no repeated run, so only the
repeated ones are ordered. Their rank in the suffix array at depth 1 is the
number of smaller symbols; depth 2h follows from depth h, as a suffix is ordered
within its group by the rank of the suffix h lines on. Ranks come from counts
and prefix sums of range partitions, so a line that a third of all rows share is
never gathered in one task.

Suffixes with equal ranks at depth h share their first h lines: they are an
interval of the array whose longest common prefix is at least h. Two overlapping
intervals of the depth below give any length between h and 2h. A run of lines is
a copy if an equal run starts earlier (by doc_id, then line), and the lines of a
copy are deleted.

A run counts if it has ``min_words`` words. It is enough to look at the shortest
runs that do, from each line on and up to each line: together they cover every
longer run, and none has more lines than ``min_words``, which bounds the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.llm.common import WORD
from leafgrid.scratch import store
from leafgrid.skew import prefix_sum

DOC = ["doc_id", "k1", "k2"]


def dedup_lines(docs: DataFrame, min_words: int = 5, carry: tuple = ()) -> DataFrame:
    """Delete later copies of repeated runs of lines from ``docs`` (doc_id, text).

    Gives doc_id, text (what is left), n_lines, n_deleted, one row per row of
    ``docs``, with the columns named in ``carry`` as a struct ``carried``. Lines
    end at a line feed. Lines without a word are no part of a
    run and stay. A run that overlaps its own copy loses all but its first line.

    Null text: stays null, 0 lines. Empty text: one blank line. Null doc_ids
    come first. Rows of equal doc_id and text are one document, so all are left
    alike; rows of equal doc_id and another text are ordered by a hash of it. An
    empty table gives no rows. Extra columns are not read.
    """
    keyed = docs.select(
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    copies = _copies(_repeated(keyed), min_words)
    deleted = store(
        copies.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line")).alias("gone")),
        "deleted",
    )
    lines = F.split("text", "\n")
    left = F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1),
        F.transform("gone", lambda n: F.element_at("spoken", n + 1)),
    )
    return (
        keyed.join(deleted, ["k1", "k2"], "left")
        .withColumn("lines", lines)
        .withColumn("spoken", F.when(F.col("gone").isNotNull(), _spoken("lines")))
        .select(
            "doc_id",
            F.when(F.col("gone").isNull(), F.col("text"))
            .otherwise(
                F.array_join(
                    F.transform(left, lambda n: F.element_at("lines", n + 1)), "\n"
                )
            )
            .alias("text"),
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
            *(["carried"] if carry else []),
        )
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
        .withColumn("n_deleted", F.greatest("n_deleted", F.lit(0).cast("long")))
    )


def _spoken(lines: str) -> Column:
    """Places of the lines that have a word."""
    return F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda n: F.element_at(lines, n + 1).rlike(WORD),
    )


def _repeated(keyed: DataFrame) -> DataFrame:
    """Lines that occur more than once: DOC, line, words and rank at depth 1."""
    spoken = F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD))
    lines = store(
        keyed.select(*DOC, F.posexplode(spoken).alias("line", "s")).select(
            *DOC,
            "line",
            F.regexp_count("s", F.lit(WORD)).alias("words"),
            F.xxhash64("s").alias("h1"),
            F.xxhash64(F.lit(1), "s").alias("h2"),
        ),
        "lines",
    )
    symbols = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    ranks = store(
        prefix_sum(
            symbols.filter("n > 1"), [], ["h1", "h2"], F.col("n"), "r1", spread=True
        ).drop("n"),
        "ranks",
    )
    # Equal rows of the input are one document.
    return (
        lines.join(ranks, ["h1", "h2"])
        .drop("h1", "h2")
        .dropDuplicates(["k1", "k2", "line"])
    )


def _double(lines: DataFrame, h: int) -> DataFrame:
    """Add the rank at depth 2h to lines that have the rank at depth h."""
    order = Window.partitionBy(*DOC).orderBy("line")
    on = F.lead(F.struct("line", f"r{h}"), h).over(order)
    # A run ends where the lines are not adjacent; the end orders first.
    beyond = F.when(on["line"] == F.col("line") + h, on[f"r{h}"]).otherwise(-1)
    lines = store(lines.withColumn("beyond", beyond), "suffixes")
    pairs = lines.groupBy(f"r{h}", "beyond").agg(F.count(F.lit(1)).alias("n"))
    ranks = prefix_sum(
        pairs, [f"r{h}"], ["beyond"], F.col("n"), "smaller", spread=True
    ).select(f"r{h}", "beyond", (F.col(f"r{h}") + F.col("smaller")).alias(f"r{2 * h}"))
    ranks = store(ranks, "ranks")
    return lines.join(ranks, [f"r{h}", "beyond"]).drop("beyond")


def _copies(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines (k1, k2, line) of runs for which an equal run starts earlier."""
    depth = 1
    while 2 * depth <= min_words:
        lines = _double(lines, depth)
        depth *= 2
    runs = store(_shortest_runs(lines, min_words), "runs")
    spot = F.struct(*DOC, "first")
    groups = runs.groupBy("length", "left", "right").agg(
        F.min(spot).alias("origin"), F.max(spot).alias("latest")
    )
    intervals = store(groups.filter("origin < latest").drop("latest"), "intervals")
    return (
        runs.join(intervals, ["length", "left", "right"])
        .filter(spot > F.col("origin"))
        .select(
            "k1",
            "k2",
            F.explode(
                F.sequence("first", F.col("first") + F.col("length") - 1)
            ).alias("line"),
        )
    )


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest run of enough words from each line on, and up to each line.

    A run is DOC, first, length and its ranks left and right: the interval of
    its first h lines and of its last h, with h <= length < 2h.
    """
    order = Window.partitionBy(*DOC).orderBy("line")
    reach = range(1, min_words)
    shifted = lines
    for way, shift in (("f", F.lead), ("b", F.lag)):
        for k in reach:
            there = shift(F.struct("line", "words"), k).over(order)
            gap = k if way == "f" else -k
            held = there["line"] == F.col("line") + gap
            shifted = shifted.withColumn(
                f"{way}{k}", F.when(held, there["words"])
            )
        shifted = shifted.withColumn(f"{way}0", F.col("words"))

    runs = []
    for way in "fb":
        length, left, right = F.lit(None), F.lit(None), F.lit(None)
        for n in range(min_words, 0, -1):
            h = 1 << (n.bit_length() - 1)
            enough = sum((F.col(f"{way}{k}") for k in range(1, n)), F.col(f"{way}0"))
            fits = enough >= min_words
            rank = F.col(f"r{h}")
            if way == "f":
                ends = rank, F.lead(rank, n - h).over(order)
            else:
                ends = F.lag(rank, n - 1).over(order), F.lag(rank, h - 1).over(order)
            length = F.when(fits, n).otherwise(length)
            left = F.when(fits, ends[0]).otherwise(left)
            right = F.when(fits, ends[1]).otherwise(right)
        first = F.col("line") - (F.lit(0) if way == "f" else length - 1)
        runs.append(F.struct(
            first.alias("first"), length.alias("length"),
            left.alias("left"), right.alias("right"),
        ))
    picked = shifted.select(*DOC, F.array(*runs).alias("runs"))
    return (
        picked.select(*DOC, F.explode(F.array_distinct("runs")).alias("run"))
        .select(*DOC, "run.*")
        .filter(F.col("length").isNotNull())
    )

"""How filters that run one after the other hide one another.

Every document gets a mask, one bit for each filter that it fails. Spark counts
the masks of each part; from there on a part is at most ``2 ** filters`` weighted
masks, whatever its size, and is worked on as a decision diagram: a level for
each filter, at each node the branch of documents that pass and of those that
fail, at each node its number of documents, of good and of toxic ones. Equal
nodes of a level are one, and branches without documents are left out. Swapping
two adjacent levels turns the diagram of one order of filters into that of
another, so all orders are reached by one swap each. The path on which
everything passes, with the branches that leave it, is the run of the filters
in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import sha256_text
from leafgrid.scratch import store

SPACE = " "
OTHER_SPACES = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The filters of ``failure_masks`` in the order of their bits.
FILTERS = "ABCDE"

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, "
    "redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails A, B, C and D.

    A: fewer than 50 words. B: under 65 % of the words are distinct, by case.
    C: more than 5 % of the code points are A-Z. D: any of ``#$%&*|``.
    """
    blanks = F.translate(text, OTHER_SPACES, SPACE * len(OTHER_SPACES))
    words = F.array_remove(F.split(blanks, SPACE), "")
    n = F.size(words)
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": capitals * 100 > length * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Counted masks: ``part, mask, n, good, toxic``, a row for each mask that occurs.

    Bit k of ``mask`` says that filter k of ``FILTERS`` fails; E fails if a smaller
    doc_id has the same text. Null texts count as empty ones, a null part as ''.
    A null doc_id has no label, is smaller than nothing and fails no E, and makes
    no other fail. Repeated rows are counted each; equal ids are not smaller than
    each other. A document is good (toxic) if any label row of it says 1. Empty
    tables give no rows.

    Rows shrink before they meet: equal (doc_id, text, part) are counted map-side,
    then equal (text, part). A to D depend on the text alone, so for E only the
    rows of a text's smallest doc_id have to be set apart from the rest.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        sha256_text(text).alias("same"),
        _mask(text_failures(text)).alias("mask"),
    )
    rows = rows.groupBy("id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    # Rows without an id have no label; their text spreads them over the tasks.
    spread = F.when(F.col("id").isNull(), F.col("same")).otherwise(F.lit(""))
    says = says.filter("labelled is not null").withColumn("said_at", F.lit(""))
    rows = rows.withColumn("at", spread).join(
        says, (F.col("id") == F.col("labelled")) & (F.col("at") == F.col("said_at")), "left"
    )
    good = F.when(F.col("good") == 1, F.col("n")).otherwise(0)
    toxic = F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)
    first = F.when(
        F.col("id").isNotNull(),
        F.struct("id", "n", good.alias("good"), toxic.alias("toxic")),
    )
    texts = rows.groupBy("same", "part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(good).alias("good"),
        F.sum(toxic).alias("toxic"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min(first).alias("first"),
    )
    texts = store(texts, "texts")  # read twice below; the documents are scanned once
    # Keyed by text and id, so a text that many parts share stays spread out.
    least = texts.groupBy("same").agg(F.min("first.id").alias("least"))
    texts = texts.join(
        least.select(F.col("same").alias("least_same"), "least"),
        (F.col("same") == F.col("least_same")) & (F.col("first.id") == F.col("least")),
        "left",
    )
    here = F.col("least").isNotNull()
    passing = F.struct(
        F.col("mask"),
        (F.when(here, F.col("first.n")).otherwise(0) + F.col("free")).alias("n"),
        F.when(here, F.col("first.good")).otherwise(0).alias("good"),
        F.when(here, F.col("first.toxic")).otherwise(0).alias("toxic"),
    )
    failing = F.struct(
        (F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"),
        *[(F.col(c) - passing[c]).alias(c) for c in ("n", "good", "toxic")],
    )
    return (
        texts.select("part", F.inline(F.array(passing, failing)))
        .filter("n > 0")
        .groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )


def _mask(failures: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for name, failed in failures.items():
        bit = 1 << FILTERS.index(name)
        mask = mask + F.when(failed, F.lit(bit)).otherwise(F.lit(0))
    return mask


def audit_filters(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, for each part of counted masks.

    ``kept`` is left after the step, ``removed`` goes at it, ``redundant`` fails
    its filter but is gone already, ``unique_fails`` fails that filter alone;
    ``good_lost`` and ``toxic_lost`` are the good and toxic ones of ``removed``;
    ``shapley`` sums the filter's ``removed`` over all orders. Parts of no rows
    do not exist, so there are none in the result.
    """

    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        weighted = {
            int(m): (int(n), int(g), int(t))
            for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])
        }
        steps = audit_part(weighted, filters)
        return pd.DataFrame(
            [(rows["part"].iloc[0], *s) for s in steps],
            columns=[f.split()[0] for f in AUDIT.split(", ")],
        )

    return masks.groupBy("part").applyInPandas(audit, AUDIT)


def audit_part(weighted: dict[int, tuple], filters: str) -> list[tuple]:
    """The rows of one part: order, step and the seven counts."""
    diagram = Diagram(weighted, len(filters))
    runs = []
    for order in all_orders(len(filters), diagram.swap):
        runs.append((order, diagram.all_pass_path()))

    fails, alone, total = ([0] * len(filters) for _ in range(3))
    for order, path in runs:
        # First in an order a filter meets all that fail it, last those of its own.
        fails[order[0]] = path[0][1][0]
        alone[order[-1]] = path[-1][1][0]
        for f, (_, gone) in zip(order, path):
            total[f] += gone[0]
    return [
        (
            "".join(filters[f] for f in order),
            k + 1,
            kept[0],
            gone[0],
            fails[f] - gone[0],
            alone[f],
            gone[1],
            gone[2],
            total[f],
        )
        for order, path in runs
        for k, (f, (kept, gone)) in enumerate(zip(order, path))
    ]


class Diagram:
    """A count-weighted decision diagram over the bits of masks.

    A node is a number; ``kids`` has its passing and its failing branch, ``weight``
    its counts. None is the branch without documents.
    """

    def __init__(self, weighted: dict[int, tuple], height: int):
        self.weight: dict[int, tuple] = {}
        self.kids: dict[int, tuple] = {}
        self.found: list[dict] = [{} for _ in range(height)]  # nodes by branches, per level
        leaves: dict[tuple, int] = {}
        row: dict[int, int | None] = {}
        for mask, counts in weighted.items():
            if counts[0]:
                leaf = leaves.setdefault(counts, len(leaves))
                self.weight[leaf] = counts
                row[mask] = leaf
        self.last = len(leaves)
        # Bit 0 is the top level: join the masks that differ in the lowest level first.
        for level in reversed(range(height)):
            tops = {m & ~(1 << level) for m in row}
            row = {
                m: self.node(level, row.get(m), row.get(m | 1 << level)) for m in tops
            }
        self.root = row.get(0)

    def node(self, level: int, passing, failing) -> int | None:
        """The node of a level with these branches, made if there is none."""
        if passing is None and failing is None:
            return None
        known = self.found[level].get((passing, failing))
        if known is None:
            known = self.last = self.last + 1
            self.kids[known] = (passing, failing)
            sides = [self.weight[b] for b in (passing, failing) if b is not None]
            self.weight[known] = tuple(map(sum, zip(*sides)))
            self.found[level][passing, failing] = known
        return known

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Its nodes stay, so those above do, too."""
        none = (None, None)
        upper = list(self.found[level].values())
        lower = {n: self.kids[n] for n in self.found[level + 1].values()}
        for n in lower:
            del self.kids[n], self.weight[n]
        self.found[level], self.found[level + 1] = {}, {}
        for n in upper:
            p, f = (lower[b] if b is not None else none for b in self.kids[n])
            kids = (self.node(level + 1, p[0], f[0]), self.node(level + 1, p[1], f[1]))
            self.kids[n] = kids
            self.found[level][kids] = n

    def all_pass_path(self) -> list[tuple]:
        """For each level the counts that pass so far and those that leave at it."""
        nothing = (0, 0, 0)
        path, at = [], self.root
        for _ in self.found:
            at, gone = self.kids[at] if at is not None else (None, None)
            path.append((self.weight.get(at, nothing), self.weight.get(gone, nothing)))
        return path


def all_orders(n: int, swap) -> Iterator[tuple]:
    """All orders of n things, each one swap of neighbours away from the last.

    Every thing has a direction; the largest that can step over a smaller
    neighbour does so, and all larger ones turn round.
    """
    order, heading = list(range(n)), [-1] * n
    yield tuple(order)
    while True:
        able = [
            v
            for at, v in enumerate(order)
            if 0 <= at + heading[v] < n and order[at + heading[v]] < v
        ]
        if not able:
            return
        mover = max(able)
        at = order.index(mover)
        to = at + heading[mover]
        order[at], order[to] = order[to], order[at]
        swap(min(at, to))
        for v in range(mover + 1, n):
            heading[v] = -heading[v]
        yield tuple(order)

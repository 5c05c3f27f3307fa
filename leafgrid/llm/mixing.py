"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents, in a seeded order, form a stream of tokens that is cut
into blocks of equal length. The mix has as many seats as the targets hold
blocks. A seat goes to the source with the highest quotient blocks / (2 q + 1),
q being the seats it has; since the method only ever adds seats as the house
grows, shard s gets the seats between house sizes s and s + 1, an integer quota
per source. A source's quotas are consecutive blocks of its stream from a
seeded start, around the end as often as needed, so almost all documents are
taken whole and each appears once in a round.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import word_count
from leafgrid.scratch import store
from leafgrid.skew import prefix_sum

# Sources are named by whoever sets the weights; their table is held by the driver.
MAX_SOURCES = 1_000_000


def fill_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Share the sum of ``sizes`` by weight, none above ``most`` times its size."""
    targets, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_ and rest > 0:
        share = rest / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * share > most * sizes[k]]
        if not full:
            for k in open_:
                targets[k] = weights[k] * share
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            rest -= targets[k]
        open_ = [k for k in open_ if k not in set(full)]
    return targets


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 q + 1); ties go to the earlier entry.

    A divisor d gives round(votes / d) seats. The search finds one that gives no
    more than ``seats``; the few left go one by one to the highest quotients.
    """
    v = np.asarray(votes, float)
    if not seats or v.sum() <= 0:
        return [0] * len(v)
    low, high = 0.0, 4 * v.sum() / seats + 2 * v.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        if np.floor(v / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    given = np.floor(v / high + 0.5)
    for _ in range(int(seats - given.sum())):
        given[np.argmax(v / (2 * given + 1))] += 1
    return [int(x) for x in given]


def mix_sources(
    docs: DataFrame,
    weights=(5.0, 2.0, 1.0),
    most: float = 3.0,
    block: int = 64,
    shards: int = 16,
    seed: int = 7,
) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): one row per document.

    Gives doc_id, source, size (words), source_size, target (of its source) and
    ``pieces``: array of (shard, repeat, first, last), the word ranges [first,
    last) of the document that the mix takes, in the order of the mix.

    ``weights`` is a dict by source, or a sequence repeated over the sources in
    the order of their code points, null last. Targets share all words by
    weight; above ``most`` times a source's size the excess is shared again.

    Null text: size 0, no pieces. Null source: a source of its own. Documents
    of equal doc_id and text are interchangeable. An empty table gives no rows,
    an empty source target 0. Extra columns are not read.
    """
    rows = store(
        docs.select(
            "doc_id",
            "source",
            F.col("source").isNull().alias("unnamed"),
            F.coalesce("source", F.lit("")).alias("name"),
            word_count("text").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("turn"),
        ),
        "sizes",
    )
    quotas = _quotas(rows, weights, most, block, shards, seed)
    streams = prefix_sum(
        rows, ["unnamed", "name"], ["turn", "doc_id"], F.col("size"), "start", spread=True
    )
    found = streams.join(F.broadcast(quotas), ["unnamed", "name"])

    # A document lies at `start` of its source's stream, and the mix reads the
    # stream from `origin` on: it meets the document at these places.
    begins = F.transform(
        F.sequence(F.lit(0), F.lit(int(most) + 1)),
        lambda k: F.col("start") - F.col("origin") + k * F.col("source_size"),
    )
    met = F.flatten(
        F.transform(
            begins,
            lambda at, k: F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda s: F.struct(
                    s.alias("shard"),
                    k.alias("repeat"),
                    F.greatest(F.lit(0), F.col("ends")[s] - at).alias("first"),
                    F.least(F.col("size"), F.col("ends")[s + 1] - at).alias("last"),
                ),
            ),
        )
    )
    pieces = F.filter(met, lambda p: p["first"] < p["last"])
    pieces = F.when(F.col("size") > 0, pieces).otherwise(F.slice(pieces, 1, 0))
    return found.select(
        "doc_id", "source", "size", "source_size", "target", pieces.alias("pieces")
    )


def taken_words() -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"]
    )


def _quotas(rows, weights, most, block, shards, seed) -> DataFrame:
    """For each source its target and the ends of its shards in the taken stream."""
    totals = rows.groupBy("unnamed", "name").agg(F.sum("size").alias("size"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["unnamed"], r["name"]))
    names = [None if r["unnamed"] else r["name"] for r in found]
    sizes = [int(r["size"]) for r in found]
    if isinstance(weights, dict):
        share = [float(weights.get(n, 0.0)) for n in names]
    else:
        share = [float(weights[k % len(weights)]) for k in range(len(names))]
    targets = fill_targets(sizes, share, most)

    # Blocks of a source are equal; `votes` is how many of them make the target.
    counts = [max(1, round(n / block)) for n in sizes]
    votes = [t * c / n if n else 0.0 for t, c, n in zip(targets, counts, sizes)]
    seats = round(sum(votes))
    houses = [sainte_lague(votes, seats * s // shards) for s in range(shards + 1)]
    out = []
    for k, r in enumerate(found):
        size, blocks = sizes[k], counts[k]
        first = zlib.crc32(f"{seed}:{names[k]!r}".encode()) % blocks
        top = int(most * blocks)

        def token(number: int) -> int:
            return number // blocks * size + number % blocks * size // blocks

        ends = [token(first + min(h[k], top)) - token(first) for h in houses]
        out.append((r["unnamed"], r["name"], size, targets[k], token(first), ends))
    return rows.sparkSession.createDataFrame(
        out,
        "unnamed boolean, name string, source_size long, target double,"
        " origin long, ends array<long>",
    )

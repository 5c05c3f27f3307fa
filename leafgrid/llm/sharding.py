"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal text are one atomic group. Groups are laid out in the order
of their smallest doc_id. The smallest capacity with which that line can be cut
into the wanted number of shards is found by binary search; each capacity is
checked greedily (fill a shard while the next group fits), so the largest shard
is as small as an ordered, undivided layout allows. Within that capacity the line
is cut where each shard comes nearest to its share of what is left.

The line itself stays distributed: prefix sums of the group sizes come from
range partitions. The search needs only the group ends next to a place. That is
answered from a bounded digest (smallest and largest end per bin), which is
refined around the cuts until every answer on the way is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.scratch import measure, store
from leafgrid.skew import prefix_sum

# Bins of group ends that the driver holds at once: two numbers for each.
DIGEST_BINS = 32_768


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) into a shard 0 .. shards - 1.

    Gives doc_id, size (UTF-8 bytes + 1), text_crc32, shard and slot, the row's
    place in its shard, gapless from 0 in the order of the line.

    Null text: size 1, no checksum; all null texts are one group, apart from the
    empty text. Null doc_ids order first. Repeated rows each get a slot, and as
    they are equal it does not matter which. An empty table gives no rows. Other
    columns of ``docs`` are not read. Fewer groups than shards leave the last
    shards empty.
    """
    rows = store(
        docs.select(
            "doc_id",
            F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.coalesce(F.sha2("text", 256), F.lit("null")).alias("group"),
        ),
        "rows",
    )
    groups = rows.groupBy("group").agg(
        F.min("doc_id").alias("first"), F.sum("size").alias("weight")
    )
    line, seen = measure(
        prefix_sum(
            groups, [], ["first", "group"], F.col("weight"), "before", spread=True
        ).withColumn("end", F.col("before") + F.col("weight")),
        "line",
        total=F.max("end"),
        largest=F.max("weight"),
    )
    cuts = minimax_cuts(line, seen["total"] or 0, seen["largest"] or 0, shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    placed = rows.join(line.select("group", "before", shard.alias("shard")), "group")
    order = ["before", "doc_id", "group"]
    return prefix_sum(
        placed, ["shard"], order, F.lit(1), "slot", spread=True
    ).select("doc_id", "size", "text_crc32", "shard", "slot")


def minimax_cuts(
    line: DataFrame, total: int, largest: int, shards: int, bins: int = DIGEST_BINS
) -> list[int]:
    """Ends of the shards for the smallest capacity that needs at most ``shards``."""
    digest = _Digest(line, total, bins)
    low, high = max(largest, -(-total // shards)), total
    while low < high:
        capacity = (low + high) // 2
        if digest.walk(capacity, shards)[-1] == total:
            high = capacity
        else:
            low = capacity + 1
    return digest.even(low, shards)


class _Digest:
    """Bounds on the group ends: sorted, disjoint (smallest, largest) per bin."""

    def __init__(self, line: DataFrame, total: int, bins: int):
        self.line, self.bins = line, bins
        self.spans = self._bounds([(1, total)]) if total else []

    def _bounds(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        per_span = max(2, self.bins // len(spans))
        end, key = F.col("end"), F.lit(None)
        for number, (first, last) in enumerate(spans):
            width = -(-(last - first + 1) // per_span)
            place = F.floor((end - first) / width) + number * per_span
            key = F.when(end.between(first, last), place).otherwise(key)
        rows = (
            self.line.groupBy(key.alias("bin"))
            .agg(F.min("end").alias("first"), F.max("end").alias("last"))
            .filter(F.col("bin").isNotNull())
            .collect()
        )
        return sorted((r["first"], r["last"]) for r in rows)

    def walk(self, capacity: int, shards: int) -> list[int]:
        """The greedy shard ends. Bins that leave a doubt are refined first."""
        while True:
            ends, doubts, at = [], [], 0
            for _ in range(shards):
                reach = at + capacity
                k = bisect_right(self.spans, (reach, float("inf"))) - 1
                if k >= 0:
                    first, last = self.spans[k]
                    if last > reach and first < last:
                        doubts.append((first, last))
                    at = max(at, last if last <= reach else first)
                ends.append(at)
            if not doubts:
                return ends
            self._refine(doubts)

    def even(self, capacity: int, shards: int) -> list[int]:
        """Shard ends near equal shares, no shard above a capacity that suffices.

        Each end is the one nearest to an equal share of what is left, if the
        rest still fits into the shards that follow. While groups are left, a
        shard has one.
        """
        total = self.spans[-1][1] if self.spans else 0
        while True:
            doubts: list[tuple[int, int]] = []
            # The smallest place from which 0, 1, 2 ... shards reach the end.
            back = [total]
            for _ in range(shards - 1):
                back.append(self._at_least(back[-1] - capacity, doubts))
            ends, at = [], 0
            for left in range(shards, 0, -1):
                aim = at + (total - at) // left
                below, above = self._at_most(aim, doubts), self._at_least(aim, doubts)
                end = below if aim - below <= above - aim else above
                end = max(end, self._at_least(min(at + 1, total), doubts), back[left - 1])
                at = min(end, self._at_most(at + capacity, doubts))
                ends.append(at)
            if not doubts:
                return ends
            self._refine(doubts)

    def _at_most(self, place: int, doubts: list) -> int:
        """The last end at or below a place, 0 without one."""
        k = bisect_right(self.spans, (place, float("inf"))) - 1
        if k < 0:
            return 0
        first, last = self.spans[k]
        if first < place < last:
            doubts.append((first, last))
        return last if last <= place else first

    def _at_least(self, place: int, doubts: list) -> int:
        """The first end at or above a place; 0 is one."""
        if place <= 0:
            return 0
        k = bisect_right(self.spans, (place, float("inf"))) - 1
        if k >= 0:
            first, last = self.spans[k]
            if first < place < last:
                doubts.append((first, last))
            if place <= last:
                return first if first == place else last
        return self.spans[min(k + 1, len(self.spans) - 1)][0]

    def _refine(self, doubts: list[tuple[int, int]]) -> None:
        doubts = sorted(set(doubts))
        rest = [s for s in self.spans if s not in set(doubts)]
        self.spans = sorted(rest + self._bounds(doubts))

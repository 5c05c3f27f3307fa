"""Near-duplicate documents by SuperMinHash, banding, verification, union-find.

1. Every whole text becomes its set of word shingles, hashed to 64 bits. Texts of
   equal sets are one class; classes are counted by a 128-bit digest of the set,
   combined before the shuffle, so copies by the thousand cost nothing later.
2. A class's SuperMinHash signature gives one key per band. Members of a bucket
   are candidates.
3. A bucket's members are not paired with one another. Each round, up to
   ``LEADERS`` members of a bucket are compared with those members that are not
   yet in their component. Round one takes the smallest member; the next ones
   take members outside the bucket's largest component, until each of those has
   led once. Then every pair of a bucket has been compared or is connected, so
   components are the same as if all pairs had been.
4. A comparison is exact: both full sets are built from the full texts. Pairs
   that their sizes or signatures rule out by far are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import U64, hash_words, mix, split_words
from leafgrid.llm.graph import components
from leafgrid.scratch import measure, store

BANDS, ROWS = 32, 6
# Members of one bucket that are compared with all others of it in one round.
LEADERS = 1024
# Bits of the parity sketch.
PARITY = 512

_GOLD = U64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``words`` words.

    A shorter text is one shingle, its whole sequence; no word gives none.
    """
    h = hash_words(split_words(text))
    if not len(h):
        return h
    size = min(words, len(h))
    s = np.full(len(h) - size + 1, U64(size))
    for k in range(size):
        s = mix(s * _GOLD + h[k : len(h) - size + 1 + k])
    return np.unique(s)


def superminhash(items: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash signature of a set of hashes.

    Item by item, a random permutation deals the ranks 0, 1, 2, ... to places of
    the signature; a place keeps its smallest rank plus fraction over all items
    (24 bits of rank, 40 of fraction). As soon as all places hold less than a
    rank, later ranks can't matter and the loop stops. Items go in chunks, which
    gives the same minima.
    """
    out = np.full(size, np.iinfo(U64).max, U64)
    for start in range(0, len(items), 2048):
        part = items[start : start + 2048]
        rows = np.arange(len(part))
        deal = None
        for j in range(size):
            if int(out.max() >> U64(40)) < j:
                break
            x = mix(part + U64((j + 1) * int(_GOLD) & _MASK))
            pick = j + (((x & U64(0xFFFFFF)) * U64(size - j)) >> U64(24)).astype(np.int64)
            if deal is None:
                place = pick
                deal = np.tile(np.arange(size, dtype=np.int16), (len(part), 1))
            else:
                place = deal[rows, pick]
            deal[rows, pick] = deal[:, j]
            np.minimum.at(out, place, (U64(j) << U64(40)) | (x >> U64(24)))
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(1, bands + 1).astype(U64)
    for column in signature.reshape(bands, -1).T:
        keys = mix(keys * _GOLD + column)
    return keys.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each place of the signature, 32 places to a number."""
    bits = np.zeros(-(-len(signature) // 32) * 32, U64)
    bits[: len(signature)] = signature & U64(3)
    shifts = 2 * np.arange(32).astype(U64)
    return np.bitwise_or.reduce(bits.reshape(-1, 32) << shifts, axis=1).view(np.int64)


def parity(items: np.ndarray) -> np.ndarray:
    """A bit per place: whether an odd number of items hash to it.

    Two sets differ in at least as many items as their bits do.
    """
    odd = np.bincount((items >> U64(7)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(batches, words: int, bands: int, rows: int):
    from xxhash import xxh3_128_intdigest

    for batch in batches:
        n, d1, d2, keys, sketches = [], [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), words)
            digest = xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            d1.append((digest >> 64) - (1 << 63))
            d2.append((digest & ((1 << 64) - 1)) - (1 << 63))
            signature = superminhash(s, bands * rows)
            keys.append(band_keys(signature, bands) if len(s) else [])
            sketches.append(np.concatenate([sketch(signature), parity(s)]))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "d1": pa.array(d1, pa.int64()),
                "d2": pa.array(d2, pa.int64()),
                "keys": pa.array(keys, pa.list_(pa.int64())),
                "sketch": pa.array(sketches, pa.list_(pa.int64())),
            }
        )


def _compare(batches, words: int, percent: int):
    for batch in batches:
        held: dict[str, np.ndarray] = {}

        def of(text):
            if text not in held:
                if len(held) > 64:
                    held.clear()
                held[text] = shingles(text, words)
            return held[text]

        linked = []
        for a, b in zip(batch.column("text_a"), batch.column("text_b")):
            s, t = of(a.as_py()), of(b.as_py())
            both = len(np.intersect1d(s, t, assume_unique=True))
            linked.append(100 * both >= percent * (len(s) + len(t) - both))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b")], ["a", "b"]
        ).filter(mask)


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Link documents (doc_id, text) whose shingle sets overlap by ``percent``.

    Gives doc_id, n_shingles, component_id (the smallest doc_id in reach, itself
    included) and kept (doc_id = component_id), one row per row of ``docs``.

    A link needs 100 * intersection >= percent * union of the full sets. Null,
    empty and blank texts have no set and are linked with nothing. Null doc_ids
    take no part: component null, not kept. Repeated rows each get a row. Rows
    of one doc_id with several texts are one node with all their links. An empty
    table gives no rows. Extra columns are not read.

    ``bands`` x ``rows`` find a pair of similarity s with 1 - (1 - s^rows)^bands:
    with 32 x 6 all but 6e-5 of pairs at 0.8 and all but 3e-7 at 0.85.
    """
    signed = store(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            lambda it: _sign(it, words, bands, rows),
            "doc_id long, n long, d1 long, d2 long, keys array<long>, sketch array<long>",
        ),
        "signed",
    )
    real = signed.filter("n > 0 and doc_id is not null")
    classes = store(
        real.groupBy("d1", "d2", "n").agg(
            F.min("doc_id").alias("first"),
            F.min_by("keys", "doc_id").alias("keys"),
            F.min_by("sketch", "doc_id").alias("sketch"),
        ),
        "classes",
    )
    links = _verified(docs, classes, words, percent, bands * rows)
    # One doc_id with several texts joins its classes.
    several = (
        real.groupBy("doc_id")
        .agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
        .filter("low <> high")
        .select("doc_id")
    )
    split = (
        real.join(several, "doc_id", "left_semi")
        .join(classes.drop("keys", "sketch"), ["d1", "d2", "n"])
        .select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    )
    found = store(components(links.union(split)), "components")
    named = classes.select(
        "d1", "d2", "n", "first", F.lit(True).alias("known")
    ).join(found, F.col("first") == F.col("node"), "left")
    named = store(
        named.select("d1", "d2", "n", F.coalesce("component", "first").alias("found")),
        "named",
    )
    component = F.coalesce("found", "doc_id")
    return signed.drop("keys", "sketch").join(named, ["d1", "d2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _verified(docs: DataFrame, classes: DataFrame, words: int, percent: int, size: int):
    """Links (a, b) that connect all linked classes, confirmed on full texts."""
    buckets = classes.select(F.col("first").alias("id"), F.explode("keys").alias("key"))
    groups = buckets.groupBy("key").agg(
        F.min("id").alias("leader"), F.max("id").alias("last")
    )
    shared = store(groups.filter("leader < last").drop("last"), "buckets")
    members = store(
        buckets.join(shared, "key").withColumn("led", F.col("id") == F.col("leader")),
        "members",
    )
    texts = store(
        docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(
            members.select("id").distinct(), "id", "left_semi"
        ).dropDuplicates(["id", "text"]),
        "texts",
    )
    sketches = classes.select(F.col("first").alias("id"), "n", "sketch")
    pairs = (
        members.filter("id <> leader")
        .select(F.col("leader").alias("a"), F.col("id").alias("b"))
        .distinct()
        .join(sketches.select(F.col("id").alias("a"), *_side("a")), "a")
        .join(sketches.select(F.col("id").alias("b"), *_side("b")), "b")
        .filter(_near(size, percent))
    )
    links, _ = _confirmed(pairs, texts, words, percent)
    members = members.drop("leader")
    placed = None
    while True:
        if placed is None:
            found = components(links).withColumnRenamed("node", "id")
            placed = members.join(store(found, "found"), "id", "left").withColumn(
                "component", F.coalesce("component", "id")
            )
            placed = store(placed, "placed")
            # Buckets that hold several components, and the largest of those.
            by_part = placed.groupBy("key", "component").agg(
                F.count(F.lit(1)).alias("rows")
            )
            main = by_part.groupBy("key").agg(
                F.max_by("component", F.struct("rows", "component")).alias("main"),
                F.count(F.lit(1)).alias("parts"),
            )
            main = store(main.filter("parts > 1").drop("parts"), "open")
            members = store(
                placed.join(main, "key").join(sketches, "id"), "members"
            )
        salt = F.pmod(F.xxhash64("id"), F.lit(LEADERS))
        leaders, seen = measure(
            members.filter("not led and component <> main")
            .groupBy("key", salt.alias("salt"))
            .agg(F.min_by(F.struct("id", "component", "n", "sketch"), "id").alias("lead"))
            .select("key", "lead.*"),
            "leaders",
            rows=F.count(F.lit(1)),
        )
        if not seen["rows"]:
            return links
        ahead = leaders.select(
            "key", F.col("id").alias("a"), F.col("component").alias("part"), *_side("a")
        )
        others = members.select("key", F.col("id").alias("b"), "component", *_side("b"))
        apart = F.col("component") != F.col("part")
        on = (others["key"] == ahead["key"]) & apart & _near(size, percent)
        more, linked = _confirmed(ahead.join(others, on), texts, words, percent)
        led = leaders.select("key", "id", F.lit(True).alias("now"))
        members = store(
            members.join(led, ["key", "id"], "left")
            .withColumn("led", F.col("led") | F.coalesce("now", F.lit(False)))
            .drop("now"),
            "members",
        )
        if linked:
            links = links.union(more)
            members, placed = members.drop("component", "main", "n", "sketch"), None


def _side(name: str):
    return [F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}")]


def _near(size: int, percent: int):
    """Whether the sets of a pair can be similar enough, by size and signature.

    The smaller set is at least the intersection and the larger at most the
    union, and the parity sketch bounds the difference of the sets from below;
    these two lose no link. Two bits of each signature place are equal with 1/4 + 3/4 of the
    similarity; the estimate may lie six standard deviations below the limit.
    """
    wanted = percent / 100
    equal = 0.25 + 0.75 * wanted
    slack = 6 * (equal * (1 - equal) / size) ** 0.5
    most = int(size * (1 - equal + slack)) + 1
    least, largest = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    differ = F.lit(0)
    for k in range(-(-size // 32)):
        x = F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])
        low = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(low)
    apart = F.lit(0)
    for k in range(-(-size // 32), -(-size // 32) + PARITY // 64):
        x = F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])
        apart = apart + F.bit_count(x)
    total = F.col("n_a") + F.col("n_b")
    return (
        (least * 100 >= largest * percent)
        & (differ <= most)
        & (apart * (100 + percent) <= total * (100 - percent))
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int):
    """Those of the candidate pairs whose full sets are similar, and if any are."""
    near = store(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "near",
    )
    with_a = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links, seen = measure(
        both.mapInArrow(lambda it: _compare(it, words, percent), "a long, b long"),
        "links",
        rows=F.count(F.lit(1)),
    )
    return links, seen["rows"]

"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; the hash is its largest coordinate by size, with its sign: the nearest
corner of the cross-polytope. ``HASHES`` of them make a bucket, ``TABLES`` times.
A vector goes into its own bucket and into the next likely ones, in which a
single hash takes its second or third corner (multiprobe).

Vectors that share a bucket are compared exactly, in blocks: a bucket is dealt
into parts of ``PART`` vectors and every pair of parts is a block, so no task
holds more than two parts, however large the bucket. A pair that meets several
times counts where its smallest common bucket is. A block gives counts of links
and the edges of a spanning forest, never its pairs. Equal vectors are one, with
their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import U64, mix
from leafgrid.llm.graph import components
from leafgrid.scratch import store

TABLES, HASHES, PROBES = 10, 3, 6
PART = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows; their length is 2^k."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """Bucket numbers of unit vectors: rows x tables x probes, own bucket first."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        corners, losses = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            near = np.argpartition(-np.abs(y), min(3, width - 1), axis=1)[:, : min(3, width)]
            size = np.take_along_axis(np.abs(y), near, 1)
            order = np.argsort(-size, axis=1)
            near, size = np.take_along_axis(near, order, 1), np.take_along_axis(size, order, 1)
            corners.append(2 * near + (np.take_along_axis(y, near, 1) < 0))
            losses.append(size[:, :1] - size)
        # Own corners, then one hash at a time on another corner, least loss first.
        swaps = [(h, c) for h in range(hashes) for c in range(1, corners[0].shape[1])]
        loss = np.stack([losses[h][:, c] for h, c in swaps], 1)
        rank = np.argsort(loss, axis=1, kind="stable")
        own = np.stack([c[:, 0] for c in corners], 1)
        for p in range(probes):
            picked = own.copy()
            if p:
                which = rank[:, min(p - 1, len(swaps) - 1)]
                for k, (h, c) in enumerate(swaps):
                    rows = which == k
                    picked[rows, h] = corners[h][rows, c]
            code = np.full(n, U64(t + 1))
            for h in range(hashes):
                code = mix(code * U64(2 * width + 1) + picked[:, h].astype(U64))
            out[:, t, p] = code.view(np.int64)
    return out


def usable(vector: str):
    """Neither null nor zero, and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda e: e != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    part: int = PART,
) -> DataFrame:
    """Link vectors (vec_id, embedding) whose cosine is at least ``cosine``.

    Gives vec_id, n_links (other vectors linked directly), component_id (the
    smallest vec_id in reach, itself included) and kept, one row per row. Cosines
    are in double precision. Vectors of different lengths aren't compared.

    Vectors that are null, empty, zero or hold null or non-finite components are
    linked with nothing. Null vec_ids count as vectors; they name no component and
    are not kept. A component that has null vec_ids only is null. Repeated rows are vectors of their own. An empty
    table gives no rows. Extra columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda e: e.cast("double") + 0.0).alias("v"),
    )
    rows = rows.withColumn("v", F.when(usable("v"), F.col("v")))
    rows = rows.withColumn("key", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    rows = store(rows, "vectors")
    classes = store(
        rows.filter("key is not null")
        .groupBy("key")
        .agg(
            F.min("vec_id").alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("v").alias("v"),
        ),
        "classes",
    )
    # A class without an id is a node all the same, but no component's name.
    classes = classes.withColumn("id", F.coalesce("first", F.xxhash64("key")))

    def hash_rows(batches):
        for batch in batches:
            values = batch.column("v").to_pylist()
            found: list = [None] * len(values)
            for size in {len(v) for v in values}:
                picked = [k for k, v in enumerate(values) if len(v) == size]
                codes = buckets(_unit(np.array([values[k] for k in picked])), tables, hashes, probes)
                codes ^= np.int64(size)
                for k, c in zip(picked, codes.reshape(len(picked), -1)):
                    found[k] = c
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "codes"]
            )

    hashed = store(
        classes.select("id", "copies", "v").mapInArrow(
            hash_rows, "id long, copies long, v array<double>, codes array<long>"
        ),
        "hashed",
    )
    members = hashed.select(
        "id", F.explode(F.array_distinct(F.slice("codes", 1, tables * probes))).alias("bucket")
    )
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    shared = store(
        counts.filter("rows > 1").select(
            "bucket", F.ceil(F.col("rows") / part).cast("int").alias("parts")
        ),
        "buckets",
    )
    # A member meets its own part and every other one: one row for each block.
    mine = F.pmod(F.xxhash64("id", "bucket"), F.col("parts")).cast("int")
    dealt = members.join(shared, "bucket").withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("id", "bucket", "mine", other).select(
        "id",
        "bucket",
        F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"),
        (F.col("mine") < F.col("other")).alias("lower"),
    )
    dealt = store(dealt, "dealt")
    order = ["bucket", "low", "high"]
    blocks = (
        dealt.join(hashed, "id")
        .repartition(*order)
        .sortWithinPartitions(*order)
    )

    per_table = probes

    def compare(batches):
        for rows in _runs(batches, order):
            found = _links(rows, cosine, tables, per_table)
            if found is not None:
                yield found

    found = store(
        blocks.mapInArrow(compare, "id long, n long, other long"), "found"
    )
    counts = found.filter("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    reach = components(
        found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    )
    links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    named = store(
        classes.select("key", "id", "first", "copies")
        .join(counts, "id", "left")
        .join(reach, F.col("id") == F.col("node"), "left")
        .select("key", "first", links.alias("n_links"), F.coalesce("component", "id").alias("group")),
        "named",
    )
    lowest = named.groupBy("group").agg(F.min("first").alias("found"))
    named = named.join(lowest, "group").select("key", "n_links", "found")
    component = F.coalesce("found", "vec_id")
    return rows.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _runs(batches, order):
    """Tables of rows that agree in ``order``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in order], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        edges = [0, *edges.tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _links(rows: pa.Table, cosine: float, tables: int, probes: int):
    """Links of a block: per vector their number, and a forest of edges."""
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    ids = rows.column("id").to_numpy()
    copies = rows.column("copies").to_numpy()
    width = len(rows.column("v")[0])
    flat = rows.column("v").combine_chunks()
    x = flat.flatten().to_numpy().reshape(len(ids), width)
    unit = _unit(x)
    if low == high:
        a = b = np.arange(len(ids))
    else:
        lower = rows.column("lower").to_numpy()
        a, b = np.flatnonzero(lower), np.flatnonzero(~lower)
    near = unit[a] @ unit[b].T >= cosine
    if low == high:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    i, j = a[i], b[j]
    # Count a pair only where its smallest common bucket is.
    bucket = rows.column("bucket")[0].as_py()
    codes = rows.column("codes").combine_chunks().flatten().to_numpy()
    codes = codes.reshape(len(ids), tables, probes)
    keep = np.empty(len(i), bool)
    for start in range(0, len(i), 8192):
        s = slice(start, start + 8192)
        p, q = codes[i[s]], codes[j[s]]
        smaller = np.zeros(len(p), bool)
        for k in range(probes):
            same = p == np.roll(q, k, axis=2)
            smaller |= (same & (p < bucket)).any((1, 2))
        keep[s] = ~smaller
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    n = np.bincount(i, weights=copies[j], minlength=len(ids))
    n += np.bincount(j, weights=copies[i], minlength=len(ids))
    edges = _forest(i, j, len(ids))
    told = np.flatnonzero(n)
    out_id = np.concatenate([ids[told], ids[edges[:, 0]]])
    out_n = np.concatenate([n[told].astype(np.int64), np.zeros(len(edges), np.int64)])
    other = np.concatenate([np.zeros(len(told), np.int64), ids[edges[:, 1]]])
    mask = np.concatenate([np.ones(len(told), bool), np.zeros(len(edges), bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array(out_id), pa.array(out_n), pa.array(other, mask=mask)], ["id", "n", "other"]
    )


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Edges (member, root) that connect what the pairs connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    members = np.flatnonzero(root != np.arange(n))
    return np.stack([members, root[members]], 1)

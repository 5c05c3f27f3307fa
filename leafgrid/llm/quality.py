"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by how often pairs of
byte classes follow one another in it (letters by case, digits, marks, breaks)
and by how often its words repeat, and encoded by one layer. Gated attention
weighs the passages, tanh(V h) times sigmoid(U h), and the weighted sum of their
codes gives the document's score. Only documents have labels; which passages
matter is learned with the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.scratch import store

# Words of a passage. The last one of a text may be shorter.
PASSAGE = 64
# At most so many labelled documents are learned from, fewer if these have more
# than so many passages in all.
FIT_DOCS, FIT_PASSAGES = 3_000, 100_000
CODE, GATE = 24, 12

_KINDS = np.full(256, 15, np.int64)
for _kind, _bytes in enumerate(
    (
        range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\v\f", b".", b",;:",
        b"!", b"?", b"|", b"#$%&*", b"@/\\_~^+=<>", b"'\"`", b"-", b"()[]{}",
    )
):
    _KINDS[list(_bytes)] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
FEATURES = 256 + 6
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64)


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage of the whole text; one for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros((1, FEATURES), np.float32)
    kinds, space = _KINDS[raw], _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    number = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    rows = int(number[-1]) + 1
    pairs = kinds[:-1] * 16 + kinds[1:] + number[:-1] * 256
    counts = np.bincount(pairs, minlength=rows * 256).reshape(rows, 256)
    out = np.zeros((rows, FEATURES), np.float32)
    out[:, :256] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    size = np.bincount(number, minlength=rows)
    words = np.bincount(number, weights=starts, minlength=rows)
    breaks = np.bincount(number, weights=kinds == 4, minlength=rows)
    out[:, 256] = np.log1p(words) / 5
    out[:, 257] = np.minimum(size / np.maximum(words, 1), 40) / 10
    out[:, 258] = np.minimum(breaks / np.maximum(words, 1), 1)
    out[:, 259] = 1
    begins = np.flatnonzero(starts)
    if len(begins):
        letters = np.where(space, np.uint64(0), _BYTES[raw])[begins[0] :]
        place = np.arange(begins[0], len(raw)) - np.repeat(
            begins, np.diff(np.append(begins, len(raw)))
        )
        word = np.add.reduceat(letters * (2 * place + 1).astype(np.uint64), begins - begins[0])
        held = number[begins]
        again = np.zeros(len(word), bool)
        again[1:] = word[1:] == word[:-1]
        out[:, 260] = 3 * np.bincount(held, weights=again, minlength=rows) / np.maximum(words, 1)
        order = np.lexsort((word, held))
        seen = np.zeros(len(word), bool)
        seen[1:] = (word[order][1:] == word[order][:-1]) & (held[order][1:] == held[order][:-1])
        out[:, 261] = 2 * np.bincount(held[order], weights=seen, minlength=rows) / np.maximum(words, 1)
    return out


class AttentionModel:
    """Encoder, gated attention and output layer; plain numpy, fitted with Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def layer(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "E": layer(FEATURES, CODE), "V": layer(CODE, GATE), "U": layer(CODE, GATE),
            "w": layer(GATE), "c": layer(CODE), "b": np.zeros(1, np.float32),
        }

    def _forward(self, x, first):
        p = self.p
        h = np.tanh(x @ p["E"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        logit = np.clip(z @ p["c"] + p["b"][0], -30, 30)
        return h, v, u, a, z, 1 / (1 + np.exp(-logit)), bag

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of the bags of rows of ``x`` that start at ``first``."""
        return self._forward(x, first)[5]

    def _gradients(self, x, first, y):
        p = self.p
        h, v, u, a, z, s, bag = self._forward(x, first)
        d_logit = (s - y) / len(y)
        d_z = d_logit[:, None] * p["c"]
        d_a = (h * d_z[bag]).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first)[bag])
        d_v = d_e[:, None] * u * p["w"] * (1 - v * v)
        d_u = d_e[:, None] * v * p["w"] * u * (1 - u)
        d_h = a[:, None] * d_z[bag] + d_v @ p["V"].T + d_u @ p["U"].T
        return {
            "E": x.T @ (d_h * (1 - h * h)), "V": h.T @ d_v, "U": h.T @ d_u,
            "w": (v * u).T @ d_e, "c": z.T @ d_logit, "b": d_logit.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], labels, epochs=30, batch=64, rate=0.01, decay=1e-4, seed=7):
        rng, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            lr = rate * (1 - epoch / epochs) + rate / 50
            for k in range(0, len(order), batch):
                picked = order[k : k + batch]
                x = np.concatenate([bags[i] for i in picked]).astype(np.float32)
                first = np.cumsum([0] + [len(bags[i]) for i in picked[:-1]])
                step += 1
                for name, g in self._gradients(x, first, y[picked]).items():
                    g = g + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    up = (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
                    self.p[name] = (self.p[name] - lr * up).astype(np.float32)
        return self


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    docs_limit: int = FIT_DOCS,
    passages_limit: int = FIT_PASSAGES,
) -> AttentionModel:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text).

    The sample is bounded: ``docs_limit`` documents in the order of a hash of the
    doc_id, whole texts of any length; it ends with the document that brings it
    to ``passages_limit`` passages. Its passages are described by the executors.
    Null labels, ids and texts are left out. Of several texts of a doc_id the
    smallest counts. Without labels, or with one label only, scores hardly differ.
    """
    marked = labels.filter("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    picked = (
        marked.groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(docs_limit)
    )
    fit = (
        docs.filter("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
    )

    def describe(batches):
        for batch in batches:
            rows = [passages(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality"),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary()),
                ],
                ["doc_id", "quality", "n", "rows"],
            )

    bags = store(
        fit.mapInArrow(describe, "doc_id long, quality int, n long, rows binary"), "bags"
    )
    sizes = bags.select("doc_id", "n", F.xxhash64("doc_id").alias("place")).collect()
    sizes.sort(key=lambda r: (r["place"], r["doc_id"]))
    before = np.cumsum([0] + [r["n"] for r in sizes])
    chosen = [r["doc_id"] for r, n in zip(sizes, before) if n < passages_limit]
    if len(chosen) < len(sizes):
        bags = bags.filter(F.col("doc_id").isin(chosen))
    found = sorted(bags.collect(), key=lambda r: r["doc_id"])
    model = AttentionModel()
    if found:
        bags = [np.frombuffer(r["rows"], np.float16).reshape(-1, FEATURES) for r in found]
        model.fit(bags, [r["quality"] for r in found])
    return model


def quality_score(spark, model: AttentionModel):
    """A function of a text column: the score of the whole text, 0 to 1."""
    held = spark.sparkContext.broadcast(model.p)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = AttentionModel()
        model.p = held.value
        one = np.zeros(1, np.int64)
        return pd.Series([float(model.score(passages(t), one)[0]) for t in texts], dtype=float)

    return score


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text): doc_id, score.

    Null and empty texts are one empty passage. Null doc_ids and repeated rows
    are kept. An empty table gives no rows. Extra columns are not read.
    """
    score = quality_score(docs.sparkSession, model)
    return docs.select("doc_id", score("text").alias("score"))

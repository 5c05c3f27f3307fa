"""Language identification by error-correcting output codes.

Every language has a codeword of bits that differs from all others in many
places. One binary classifier per bit, logistic on hashed byte n-grams, predicts
it. A text gets the language whose codeword loses least, the loss of a bit being
that of its classifier's margin, weighted by how well the bit is learned. If the
second codeword is about as near, the prediction is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
# Hashed places of the n-grams of two and three bytes.
PLACES = 2_048
# At most about so many documents are learned from, spread over the languages.
FIT_DOCS = 4_000
AMBIGUOUS = 0.2

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[33:65] = 32
_FOLD[91:97] = 32
_FOLD[123:127] = 32


def profile(text: str) -> np.ndarray:
    """Square roots of n-gram shares of the whole text, of length one."""
    b = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep]
    two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(21)
    counts = np.bincount(two, minlength=PLACES)
    if len(b) > 2:
        three = b[:-2] * np.uint32(0xC2B2AE3D) + b[1:-1] * np.uint32(0x27D4EB2F)
        three = (three + b[2:] * np.uint32(0x165667B1)) >> np.uint32(21)
        counts = counts + np.bincount(three, minlength=PLACES)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of bits (0, 1) per class.

    Up to six classes: all ways to split them in two, the exhaustive code. More:
    the best of some random codes of 10 log2(classes) bits, by least distance.
    """
    if classes <= 6:
        splits = range(1, 2 ** max(classes - 1, 1))
        return np.array([[s >> k & 1 for s in splits] for k in range(classes)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, most = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (classes, bits))
        code = code[:, (code.min(0) != code.max(0))]
        apart = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(classes, dtype=int)
        if apart.min() > most:
            best, most = code, int(apart.min())
    return best


class CodeModel:
    """Languages, their codewords and one linear classifier per bit."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 0))
        self.weights = np.zeros((PLACES, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.trust = np.ones(self.code.shape[1])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs=15, batch=64, rate=0.02, seed=7):
        """Adam on the logistic losses of all bits; classes count alike."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.languages))
        weight = (1 / np.maximum(share, 1))[y]
        weight = (weight / weight.mean()).astype(np.float32)[:, None]
        params = [self.weights, self.bias]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            lr = rate * (1 - epoch / epochs) + rate / 50
            for k in range(0, len(order), batch):
                i = order[k : k + batch]
                step += 1
                margin = np.clip(x[i] @ params[0] + params[1], -30, 30)
                d = (1 / (1 + np.exp(-margin)) - self.code[y[i]]) * weight[i] / len(i)
                for n, g in enumerate((x[i].T @ d, d.sum(0))):
                    m[n] = 0.9 * m[n] + 0.1 * g
                    s[n] = 0.999 * s[n] + 0.001 * g * g
                    up = (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)
                    params[n] = (params[n] - lr * up).astype(np.float32)
        self.weights, self.bias = params
        right = ((x @ self.weights + self.bias > 0) == self.code[y]).astype(float)
        hit = (right * weight).sum(0) / weight.sum()
        self.trust = np.log(np.clip(hit, 0.51, 0.999) / (1 - np.clip(hit, 0.51, 0.999)))
        return self

    def predict(self, x: np.ndarray):
        """For each profile the language, its share of certainty, and ambiguity."""
        margin = x @ self.weights + self.bias
        sign = 2.0 * self.code - 1
        loss = np.logaddexp(0, -margin[:, None, :] * sign[None]) * self.trust
        loss = loss.sum(2) / max(self.trust.sum(), 1e-9) * max(1, sign.shape[1])
        near = np.exp(loss.min(1, keepdims=True) - loss)
        near /= near.sum(1, keepdims=True)
        ranked = np.sort(near, axis=1)
        second = ranked[:, -2] if near.shape[1] > 1 else np.zeros(len(near))
        return near.argmax(1), ranked[:, -1], ranked[:, -1] - second < AMBIGUOUS


def fit_language(docs: DataFrame, docs_limit: int = FIT_DOCS) -> CodeModel:
    """Learn from ``docs`` (text, lang) with both given.

    The sample is bounded: about ``docs_limit`` whole texts of any length, picked
    by a hash of the text, a like number of each language (all of a rare one).
    Languages are held by the driver.
    """
    marked = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = {r["lang"]: r["count"] for r in marked.groupBy("lang").count().collect()}
    model = CodeModel(sorted(counts))
    if not counts:
        return model
    each = max(20, docs_limit // len(counts))
    share = F.create_map(
        *[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * each / n))]
    )
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    picked = marked.filter(chance < share[F.col("lang")])

    def describe(batches):
        for batch in batches:
            rows = [profile(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "row"]
            )

    found = picked.mapInArrow(describe, "lang string, row binary").distinct()
    found = found.orderBy(F.xxhash64("row"), "lang").limit(2 * docs_limit + 20 * len(counts)).collect()
    place = {lang: k for k, lang in enumerate(model.languages)}
    x = np.array([np.frombuffer(r["row"], np.float16) for r in found], np.float32)
    return model.fit(x, np.array([place[r["lang"]] for r in found])) if len(found) else model


def identify_language(docs: DataFrame, model: CodeModel) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (0 to 1), ambiguous.

    A null text, one without a letter, or a model without languages give ``und``
    with score 0. Null doc_ids and repeated rows are kept. An empty table gives
    no rows. Extra columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = batch.column("known").to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            told = [k for k, ok in enumerate(known) if ok and model.languages]
            for start in range(0, len(told), 256):
                part = told[start : start + 256]
                best = model.predict(np.array([profile(texts[k]) for k in part]))
                for k, b, s, u in zip(part, *best):
                    lang[k], score[k], unsure[k] = model.languages[b], float(s), bool(u)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(unsure, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", known.alias("known")
    ).mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")

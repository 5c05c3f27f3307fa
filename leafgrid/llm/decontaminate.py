"""Passages of a benchmark inside documents, by one Aho-Corasick automaton.

A document is normalised once: A-Z in lower case, each run of other ASCII than
letters and digits to one blank. The patterns are windows of the normalised
items, so one scan of the text finds the occurrences of all of them, overlapping
ones included. Words keep their number, which leads back to their place in the
original text.

Texts are scanned as their UTF-8 bytes, each byte as one character; windows start
and end with a blank, so no match starts inside a character.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch

# Bytes of windows that one automaton holds; more windows make more automata.
AUTOMATON_BYTES = 32 * 1024 * 1024

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# What the words of an item are for SQL, once it is in lower case.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32
    for b in range(256)
)

FOUND = (
    "n_words long, n_hit long, spans array<struct<start: long, end: long>>, "
    "items array<string>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

_automata: dict[str, object] = {}


def item_windows(benchmark: DataFrame, words: int) -> DataFrame:
    """Distinct ``window, item_id``: each run of so many words of each item.

    An item of fewer words is one window, one without words or text none. Null
    item_ids stay; their windows hit words, but name no item.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.regexp_extract_all(lower, F.lit(f"({LOWER_WORD})")).alias("ws"),
    ).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - words, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.array_join(F.slice("ws", k + 1, F.lit(words)), " "),
    )
    return items.select(F.explode(windows).alias("window"), "item_id").distinct()


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 10,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``doc_id`` with the benchmark passages in each whole text, a row per row.

    ``n_words`` counts the words, ``n_hit`` those in any occurrence of a window,
    ``spans`` gives their runs as code points of the original text, from the
    start of a first to behind a last word, ``items`` the distinct item_ids with
    occurring windows, in string order. Null and empty texts have no words, null
    doc_ids stay, repeated rows get a row each. Empty tables: no rows, or no hits.

    The windows are stored and measured. Up to ``automaton_bytes`` they are one
    automaton, broadcast; otherwise they are dealt by hash over as many as are
    needed, and the documents pass through one after the other, with their hits
    so far stored in between. All items of one window are held together.
    """
    pairs = F.sum(F.octet_length("window") + F.length(F.coalesce("item_id", F.lit(""))) + 16)
    windows, seen = scratch.measure(item_windows(benchmark, words), "windows", size=pairs)
    parts = max(1, -(-(seen["size"] or 0) // automaton_bytes))

    found = docs.select("doc_id", "text")
    for part in range(parts):
        dealt = F.pmod(F.xxhash64("window"), F.lit(parts)) == part
        held = windows.filter(dealt).toPandas()
        last = part == parts - 1
        found = _scan(found, list(zip(held["window"], held["item_id"])), last)
        if not last:
            found = scratch.store(found, "scanned")
    return found


def _scan(docs: DataFrame, windows: list[tuple], last: bool) -> DataFrame:
    """Adds the hits of some windows to the hits so far; at last without the text."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(windows), uuid.uuid4().hex
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hits = FOUND if last else "hit_words array<int>, items array<string>"
    text = "" if last else "text string, "

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared)
        for batch in batches:
            yield _scan_batch(batch, automaton, last)

    return docs.mapInArrow(scan, f"doc_id {id_type}, {text}{hits}")


def _automaton(key: str, shared):
    """The automaton of the broadcast windows, built once per worker."""
    if key not in _automata:
        import ahocorasick

        items: dict[str, set] = {}
        for window, item in shared.value:
            items.setdefault(window, set()).add(item)
        built = ahocorasick.Automaton()
        for window, ids in items.items():
            form = " " + window.encode("utf-8", "surrogatepass").decode("latin-1") + " "
            ids.discard(None)
            built.add_word(form, (form.count(" ") - 1, tuple(ids)))
        if items:
            built.make_automaton()
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def _scan_batch(batch: pa.RecordBatch, automaton, last: bool) -> pa.RecordBatch:
    held = dict(zip(batch.schema.names, batch.columns))
    earlier = zip(held["hit_words"].to_pylist(), held["items"].to_pylist()) if "items" in held else None
    n_words, n_hit, spans, items, hit_words = [], [], [], [], []
    for text in held["text"]:
        text = text.as_py() or ""
        count, hit, found = occurrences(text, automaton)
        if earlier:
            before, known = next(earlier)
            hit = np.union1d(hit, np.array(before, np.int64)).astype(np.int64)
            found = found.union(known)
        items.append(sorted(found))
        if last:
            n_words.append(count)
            n_hit.append(len(hit))
            spans.append(word_spans(text, hit))
        else:
            hit_words.append(hit)
    items = pa.array(items, pa.list_(pa.string()))
    if last:
        columns = {
            "doc_id": held["doc_id"],
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "spans": pa.array(spans, _SPANS),
            "items": items,
        }
    else:
        columns = {
            "doc_id": held["doc_id"],
            "text": held["text"],
            "hit_words": pa.array(hit_words, pa.list_(pa.int32())),
            "items": items,
        }
    return pa.RecordBatch.from_pydict(columns)


def occurrences(text: str, automaton) -> tuple[int, np.ndarray, set]:
    """The number of words, the numbers of those hit, and the items found."""
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    nothing = np.empty(0, np.int64)
    if not words or not len(automaton):
        return len(words), nothing, set()
    form = (b" " + b" ".join(words) + b" ").decode("latin-1")
    matches = list(automaton.iter(form))
    if not matches:
        return len(words), nothing, set()
    blanks = np.flatnonzero(np.frombuffer(form.encode("latin-1"), np.uint8) == 32)
    # The blank after a window's last word tells how many words lie before it.
    behind = np.searchsorted(blanks, [end for end, _ in matches])
    length = np.array([n for _, (n, _) in matches])
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, behind - length, 1)
    np.add.at(depth, behind, -1)
    found = set().union(*{ids for _, (_, ids) in matches})
    return len(words), np.flatnonzero(np.cumsum(depth[:-1])), found


def word_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of the words with these numbers, as places in the text."""
    if not len(hit):
        return []
    places = [m.span() for m in WORD.finditer(text)]
    breaks = np.flatnonzero(np.diff(hit) > 1)
    firsts = hit[np.concatenate([[0], breaks + 1])]
    lasts = hit[np.concatenate([breaks, [len(hit) - 1]])]
    return [
        {"start": places[a][0], "end": places[b][1]}
        for a, b in zip(firsts.tolist(), lasts.tolist())
    ]

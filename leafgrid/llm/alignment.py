"""Tokens of two tokenizers aligned by the bytes that they stand for.

Texts are shuffled by their full text, so each distinct one is tokenised and
aligned once. Its pair counts weigh as often as the text occurs, and its measures
go back to all documents that have it.

Both vocabularies cut a text before a blank that follows something else than white
space, and no token or merge spans such a place. The text between two cuts, a
unit, is therefore encoded and aligned alike wherever it stands; a task remembers
units and joins their results. A vocabulary with tokens across a blank takes whole
texts as units.

The bytes that end a token of either side cut a unit into segments. Each lies in
one token of A and one of B, and each pair of overlapping tokens shares exactly
one of them, so segments are links. Segments that end both close a group.

Counts of pairs are too many to broadcast. Tasks work on chunks of texts; a chunk
states its distinct pairs, has their corpus-wide counts joined to them, and is
met by them again for the measures of its texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid import scratch

# UTF-8 bytes of the texts of one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 * 1024 * 1024
# Units that a task remembers, twice this at most, and the longest that it does.
# One takes some 400 bytes.
KNOWN_UNITS, LONGEST_KNOWN = 80_000, 64
# New units are encoded in runs of about so many characters.
RUN_CHARS = 65_536

B_BITS = 32
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_CUT = re.compile(r"(?<=\S) (?=[^ ])")
_SPACED = re.compile(r"^ |[^\S ] |  | $")

_CHUNK_SCHEMA = pa.schema(
    [
        ("chunk", pa.int64()),
        ("key", pa.binary()),
        *[(m, pa.int64()) for m in MEASURES[:4]],
        ("groups", pa.string()),
        ("units", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())),
        ("weights", pa.list_(pa.int64())),
        ("unit_links", pa.list_(pa.int32())),
        ("unit_pairs", pa.list_(pa.int32())),
    ]
)
_CHUNK = (
    "chunk long, key binary, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, units array<int>, pairs array<long>, weights array<long>, "
    "unit_links array<int>, unit_pairs array<int>"
)
_MEASURED = "key binary, groups string, " + ", ".join(f"{m} long" for m in MEASURES)

_loaded: dict[tuple, "Aligner"] = {}


def align_tokenizers(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    keep: Callable[[bytes], str] = bytes.decode,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``doc_id``, the measures of its text's alignment, and ``groups``.

    A encodes a blank and the text, B the text, to which it adds the blank itself.
    ``groups`` lists the groups in order, as ``a1,a2|b1;a3|b2,b3``; ``keep`` says
    in the task what is kept of that. ``n_best`` counts the links whose pair is as
    frequent in the corpus as any of its B token, ``count_sum`` adds up the counts
    of all links' pairs.

    Null and empty texts, and texts whose tokens' bytes are not the text's, have
    zeros, empty ``groups`` and no part in the counts. A row per row: null and
    repeated doc_ids stay. Empty tables give no rows; other columns are left out.
    """
    texts = docs.filter("text is not null and text <> ''").groupBy("text")
    texts = texts.agg(F.count(F.lit(1)).alias("copies"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for n, rows in enumerate(_chunks(batches, chunk_bytes)):
            yield aligner.chunk(first + n, rows, keep)

    chunks = scratch.store(
        texts.select(_key(), "text", "copies").mapInArrow(align, _CHUNK), "chunks"
    )
    # One row per chunk and pair, so counting shuffles no pair per text.
    stated = chunks.filter("key is null").select(
        "chunk", F.inline(F.arrays_zip("pairs", "weights"))
    )
    total = stated.groupBy("pairs").agg(F.sum("weights").alias("total"))
    b = F.col("pairs").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # No more rows for one B token than A has tokens.
    most = F.max("total").over(Window.partitionBy(b))
    total = total.select("pairs", "total", (F.col("total") == most).alias("best"))
    told = stated.select(F.col("chunk").alias("of"), "pairs").join(total, "pairs")
    measured = (
        chunks.groupBy("chunk")
        .cogroup(told.groupBy("of"))
        .applyInArrow(_measure, _MEASURED)
    )
    measured = scratch.store(measured, "measured")
    keyed = docs.select("doc_id", _key())
    found = keyed.join(measured, "key", "left")
    return found.select(
        "doc_id",
        *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES],
        F.coalesce("groups", F.lit("")).alias("groups"),
    )


def _key():
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("key")


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[list[tuple]]:
    """Rows of key, text and copies whose texts together hold ``chunk_bytes``."""
    rows, held = [], 0
    for batch in batches:
        for key, text, copies in zip(*batch.columns):
            text = text.as_py()
            rows.append((key.as_py(), text, copies.as_py()))
            held += len(text.encode("utf-8", "surrogatepass"))
            if held >= chunk_bytes:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """The measures of a chunk's texts, from the counts of its pairs."""
    for aligner in _loaded.values():  # all units are aligned by now
        aligner.forget()
    is_text = left["key"].is_valid()
    stated, texts = left.filter(pc.invert(is_text)), left.filter(is_text)
    links = stated["unit_links"].combine_chunks().flatten().to_numpy()
    at = stated["unit_pairs"].combine_chunks().flatten().to_numpy()
    order = np.argsort(right["pairs"].to_numpy())
    total = right["total"].to_numpy()[order]
    best = right["best"].to_numpy(zero_copy_only=False)[order]
    # Sums over each unit, then over the units of each text.
    ends = np.concatenate([[0], np.cumsum(links)])
    per_unit = [_between(ends, v[at]) for v in (best.astype(np.int64), total)]
    units = texts["units"].combine_chunks()
    values = units.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(units).to_numpy())])
    n_best, count_sum = (_between(ends, v[values]) for v in per_unit)
    columns = {c: texts[c] for c in ("key", "groups", *MEASURES[:4])}
    return pa.table({**columns, "n_best": n_best, "count_sum": count_sum})


def _between(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def load(path_a: str | None = None, path_b: str | None = None) -> "Aligner":
    """The aligner of two vocabulary files, loaded once per process."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
        path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Aligner:
    """A byte-level vocabulary (A) beside a piece vocabulary (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes = _level_bytes(self.a.get_vocab(with_added_tokens=True))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)])
            if self.b.is_byte(i)
            else p.replace("▁", " ").encode("utf-8")
            for i, p in enumerate(pieces)
        ]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        # Decimal ids as bytes, with room for the mark that follows.
        shown = [b"%d" % n for n in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.n_digits = np.array([len(d) for d in shown])
        width = len(shown[-1]) + 1
        self.digits = np.array(shown, f"S{width}").view(np.uint8).reshape(-1, width)
        tokens = (t.decode("utf-8", "replace") for t in (*self.a_bytes, *self.b_bytes))
        spans = any(re.search(r"\S ", t) for t in tokens)
        self.cut = (lambda text: [text]) if spans else cut_text
        # Results of units in two generations, see ``learn``.
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def chunk(self, number: int, rows: list[tuple], keep) -> pa.RecordBatch:
        """A row for each text, and at last one without key for the chunk."""
        places = _Numbered()
        find = places.__getitem__
        texts = []
        for _, text, _ in rows:
            parts = self.cut(text)
            texts.append(np.fromiter(map(find, parts), np.int32, len(parts)))
        units = self.learn(list(places))
        sound = np.array([u is not None for u in units])
        nothing = (b"", 0, 0, 0, b"")
        units = [u or nothing for u in units]
        sizes = np.empty((len(units), 4), np.int64)
        sizes[:, 0] = [len(u[0]) // 8 for u in units]
        for k in (1, 2, 3):
            sizes[:, k] = [u[k] for u in units]
        strings = [u[4] for u in units]

        groups, counts = [], []
        for n, at in enumerate(texts):
            if not sound[at].all():
                at = texts[n] = at[:0]
            counts.append(sizes[at].sum(axis=0))
            line = b";".join(map(strings.__getitem__, at.tolist()))
            groups.append(keep(line) if len(at) else "")
        copies = np.repeat([r[2] for r in rows], [len(at) for at in texts])
        weights = np.bincount(np.concatenate(texts), copies, len(units))
        # Units of unsound texts alone have no part in the counts.
        sizes[weights == 0] = 0
        links = np.frombuffer(
            b"".join(u[0] for u, w in zip(units, weights) if w), np.int64
        )
        used = np.repeat(weights, sizes[:, 0])
        pairs, at = np.unique(links, return_inverse=True)
        counted = np.bincount(at, used, len(pairs)).astype(np.int64)
        counts = np.array(counts, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (len(rows) + 1), pa.int64()),
                pa.array([r[0] for r in rows] + [None], pa.binary()),
                *[pa.array([*counts[:, k].tolist(), None], pa.int64()) for k in (1, 2, 3, 0)],
                pa.array([*groups, None], pa.string()),
                _lists([*texts, None], pa.int32()),
                *[
                    _lists([None] * len(rows) + [v], t)
                    for v, t in (
                        (pairs, pa.int64()),
                        (counted, pa.int64()),
                        (sizes[:, 0], pa.int32()),
                        (at, pa.int32()),
                    )
                ],
            ],
            schema=_CHUNK_SCHEMA,
        )

    def learn(self, units: list[str]) -> list[tuple | None]:
        """For each unit its links, numbers of tokens and groups, and the groups.

        None stands for units whose bytes are not those of their tokens. The older
        of two generations goes when the newer is full; a unit that is asked for
        again moves to the newer.
        """
        held = {}
        for u in units:
            result = self.known.get(u, False)
            if result is False:
                result = self.older.get(u, False)
            if result is not False:
                held[u] = result
        new = [u for u in units if u not in held]
        held.update(zip(new, self.align(new)))
        if len(self.known) > KNOWN_UNITS:
            self.known, self.older = {}, self.known
        self.known.update((u, r) for u, r in held.items() if len(u) <= LONGEST_KNOWN)
        return [held[u] for u in units]

    def forget(self) -> None:
        """Drop the results of units that were remembered."""
        self.known, self.older = {}, {}

    def align(self, units: list[str]) -> list[tuple | None]:
        """Encode and align units, many in one run of numpy work."""
        out: list[tuple | None] = []
        start = held = 0
        for n, u in enumerate(units):
            held += len(u)
            if held >= RUN_CHARS or n == len(units) - 1:
                out += self._align_run(units[start : n + 1])
                start, held = n + 1, 0
        return out

    def _align_run(self, units: list[str]) -> list[tuple | None]:
        """Results of units that are encoded as one text.

        Where that cannot be, or the bytes differ, each half is tried by itself.
        """
        if len(units) == 1 or all(map(_joins, units)):
            data = [b" " + u.encode("utf-8", "surrogatepass") for u in units]
            found = self._links(units, data)
            if found is not None:
                return found
        if len(units) == 1:
            return [None]
        half = len(units) // 2
        return self._align_run(units[:half]) + self._align_run(units[half:])

    def _links(self, units: list[str], data: list[bytes]) -> list[tuple] | None:
        text, whole = " " + " ".join(units), b"".join(data)
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = list(chain.from_iterable(self.b.encode(units, num_threads=1)))
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        unit_end = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        ends = np.union1d(a_end, b_end)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(unit_end, shared, assume_unique=True).all():
            return None
        # The token that holds a segment is the first that ends with or behind it.
        links = a[np.searchsorted(a_end, ends)] << B_BITS | b[np.searchsorted(b_end, ends)]
        held = links.tobytes()
        line, line_end = self._line(
            a, b, np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        )
        at = [np.searchsorted(e, unit_end) + 1 for e in (ends, a_end, b_end, shared)]
        at.append(line_end[at[3] - 1])
        at = [[0, *places.tolist()] for places in at]
        return [
            (held[8 * s : 8 * t], a1 - a0, b1 - b0, g1 - g0, line[c : d - 1])
            for (s, t), (a0, a1), (b0, b1), (g0, g1), (c, d) in zip(*map(pairwise, at))
        ]

    def _line(self, a, b, a_group, b_group) -> tuple[bytes, np.ndarray]:
        """The groups as one text, each with a semicolon, and where they end."""
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        # A token stands behind those of its side and of the groups before it.
        a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        rows = np.empty((len(a) + len(b), self.digits.shape[1]), np.uint8)
        rows[a_at] = self.digits[a]
        rows[b_at] = self.digits[b]
        size = np.empty(len(rows), np.int64)
        size[a_at], size[b_at] = self.n_digits[a], self.n_digits[b]
        mark = np.empty(len(rows), np.uint8)
        mark[a_at] = np.where(a_last, ord("|"), ord(","))
        mark[b_at] = np.where(b_last, ord(";"), ord(","))
        rows[np.arange(len(rows)), size] = mark
        return rows[rows > 0].tobytes(), np.cumsum(size + 1)[b_at[b_last]]


def cut_text(text: str) -> list[str]:
    """Units of a text, without the blank that each starts with.

    Runs of blanks, and blanks after other white space, stay inside a unit.
    """
    return _CUT.split(text) if _SPACED.search(text) else text.split(" ")


def _joins(unit: str) -> bool:
    """Whether a unit stays one between others."""
    return bool(unit) and unit[0] != " " and not unit[-1].isspace()


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    sizes = [0 if v is None else len(v) for v in values]
    flat = [v for v in values if v is not None and len(v)]
    flat = np.concatenate(flat) if flat else np.empty(0)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
        pa.array(flat, kind, safe=False),
        mask=pa.array([v is None for v in values]),
    )


def _level_bytes(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, n in vocab.items():
        if all(c in byte for c in token):
            out[n] = bytes(byte[c] for c in token)
    return out

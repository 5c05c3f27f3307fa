"""BPE encoding and decoding; long texts by tree concatenation.

A text of up to ``piece`` characters is encoded in one go. A longer one is cut
into halves, and those again, down to that size, wherever the middle falls. The
pieces are encoded in parallel tasks and joined as a tree. The tokens next to a
cut may be wrong, so each join encodes a window around it anew, from a token
start on the left to a token end on the right, and widens it until its outer
tokens are exactly those that both sides have there. What lies beyond is right:
a byte-pair encoding depends on adjacent tokens only.

A vocabulary that lowers case and splits words at white space has its words
encoded once per task and looked up after that; any other encodes whole texts.
Words of small Latin letters, which it neither changes nor splits, go to its merges
alone; their last tokens say where they end.
Without a decoder, decoding joins token strings, which Arrow does.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 16_384
# Words whose tokens a task remembers, twice this at most, and the longest that it
# does. One takes some 200 bytes, which an idle worker keeps.
KNOWN_WORDS, LONGEST_KNOWN = 120_000, 64
# Tokens on which window and side have to agree.
AGREE = 2
SPACES = " \n\t\r"
# New words are encoded this many at a time, with a word of this mark between.
TOGETHER, MARK = 1_000, "\x01"

# The stop or comma stands first, as that is what a search skips to.
_STOP = re.compile(rb"[.,](?<=[a-z0-9][.,])(?=[ \n])")
# UTF-8 bytes of a-z and of the small letters of Latin-1.
_PLAIN = bytes([*range(97, 123), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
# Fixed value: the parts of words that `_spaced` is right for.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, "Codec"] = {}


def codec(path: str | None = None) -> "Codec":
    """The codec of a vocabulary file, loaded once per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


class Codec:
    """A tokenizer without special tokens, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = _splits_words(spec)
        self.merges = _merges(spec) if self.by_words else None
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.tokens = None
        if self.tokenizer.decoder is None:
            held = self.tokenizer.get_vocab(with_added_tokens=True)
            tokens: list = [None] * (max(held.values(), default=-1) + 1)
            for token, k in held.items():
                tokens[k] = token
            self.tokens = pa.array(tokens, pa.large_string())
        # Tokens of words, in two generations: the older one goes when the newer
        # is full, and a word that is asked for again moves to the newer.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def spans(self, text: str):
        """Token ids of a text with their starts and ends."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, np.int32), places[:, 0], places[:, 1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text: those of its words, one after the other."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in found]
        # Arrow splits the texts and numbers their words, so that each distinct one
        # is looked up once, whatever the number of times that it occurs.
        lists = pc.ascii_split_whitespace(_strings([_spaced(t) for t in texts]))
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        words = words.tolist()
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, new = self.known, []
        known[b""] = b""  # beside white space at the ends of a text
        for w in words:
            if w not in known:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    known[w] = ids
        self._learn(new)
        held = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST_KNOWN:
                del known[w]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
        ids = pa.array(np.frombuffer(b"".join(held), np.int32))
        at = numbered.indices
        ids = pa.LargeListArray.from_arrays(ends, ids).take(at).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at.to_numpy()])])
        return np.split(ids, ends[lists.offsets.to_numpy()[1:-1]]) if texts else []

    def _learn(self, words: list[bytes]) -> None:
        """Add the ids of words, many to a call; those that could mix, one to a call."""
        words = self._learn_plain(words)
        if not words:
            return
        alone = [w for w in words if b"\x01" in w or b"<|" in w]
        rest = [w for w in words if b"\x01" not in w and b"<|" not in w]
        encode = self.tokenizer.encode_batch_fast
        for start in range(0, len(rest), TOGETHER):
            part = rest[start : start + TOGETHER]
            text = f" {MARK} ".join([w.decode("utf-8") for w in part])
            ids = np.array(encode([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark[0]).tolist() if len(self.mark) == 1 else []
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            held, begin = ids.tobytes(), 0
            for w, cut in zip(part, [*cuts, len(ids)]):
                self.known[w] = held[4 * begin : 4 * cut]
                begin = cut + 1
        found = encode([w.decode("utf-8") for w in alone], add_special_tokens=False)
        for w, e in zip(alone, found):
            self.known[w] = np.array(e.ids, np.int32).tobytes()

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Add the ids of words of small Latin letters, and return the others."""
        if self.merges is None:
            return words
        tokenizer, last, level = self.merges
        plain = [w for w in words if not w.translate(None, _PLAIN)]
        left = [w for w in words if w.translate(None, _PLAIN)]
        for start in range(0, len(plain), TOGETHER):
            part = plain[start : start + TOGETHER]
            text = b" ".join(part).decode("latin-1").translate(level)
            ids = np.array(
                tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32
            )
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) != len(part):
                left += part
                continue
            held = ids.tobytes()
            for w, begin, end in zip(part, [0, *ends], ends):
                self.known[w] = held[4 * begin : 4 * end]
        return left

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The text of each list of ids."""
        if self.tokens is None:
            texts = self.tokenizer.decode_batch(
                [i.tolist() for i in ids], skip_special_tokens=False
            )
            return pa.array(texts, pa.string())
        ends = np.cumsum([0] + [len(i) for i in ids])
        held = self.tokens.take(pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), held)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())

    def join(self, left, right):
        """Join (text, ids) of two adjacent halves to that of their whole."""
        (a_text, a_ids), (b_text, b_ids) = left, right
        reach = 64
        while True:
            first = max(a_text.rfind(c, 0, max(0, len(a_text) - reach)) for c in SPACES) + 1
            ends = [b_text.find(c, reach) for c in SPACES]
            last = min((e for e in ends if e >= 0), default=len(b_text))
            a_tail, a_starts, _ = self.spans(a_text[first:])
            b_head, _, b_ends = self.spans(b_text[:last])

            k = int(np.searchsorted(a_starts, len(a_text) - first - reach, "right")) - 1
            k = int(np.searchsorted(a_starts, a_starts[k])) if k > 0 else 0
            m = int(np.searchsorted(b_ends, reach))
            m = int(np.searchsorted(b_ends, b_ends[m], "right")) if m < len(b_ends) else m
            begin = int(a_starts[k]) if k else 0
            end = int(b_ends[m - 1]) if m < len(b_ends) else last
            window = a_text[first + begin :] + b_text[:end]
            ids, starts, stops = self.spans(window)
            cut = len(a_text) - first - begin
            same_left = k == 0 or (
                np.array_equal(ids[:AGREE], a_tail[k : k + AGREE])
                and np.array_equal(starts[:AGREE] + begin, a_starts[k : k + AGREE])
            )
            same_right = m == len(b_ends) or (
                np.array_equal(ids[-AGREE:], b_head[max(0, m - AGREE) : m])
                and np.array_equal(stops[-AGREE:] - cut, b_ends[max(0, m - AGREE) : m])
            )
            if same_left and same_right:
                kept = a_ids[: len(a_ids) - (len(a_tail) - k)]
                joined = np.concatenate([kept, ids, b_ids[m:]])
                return a_text + b_text, joined
            reach *= 2

    def tree(self, pieces: list) -> np.ndarray:
        """Ids of a text from the (text, ids) of its pieces."""
        while len(pieces) > 1:
            joined = [self.join(*pieces[k : k + 2]) for k in range(0, len(pieces) - 1, 2)]
            pieces = joined + pieces[len(joined) * 2 :]
        return pieces[0][1]


def _splits_words(spec: dict) -> bool:
    """Whether a vocabulary's words can be encoded one by one, in lower case."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and cuts[0]["pattern"] == {"Regex": _PARTS}
        and not cuts[1]["add_prefix_space"]
    )


def _merges(spec: dict):
    """A vocabulary's merges without its normalizer and rules of splitting.

    Gives a tokenizer that splits at blanks, whether each id ends a word, and the
    character that stands for each byte but the blank; None for a vocabulary whose
    tokens do not say that they end a word, or that has tokens beside its merges.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    model = spec["model"]
    suffix = model.get("end_of_word_suffix")
    if (
        model["type"] != "BPE"
        or not suffix
        or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix"))
        or any("<|" not in t["content"] for t in spec["added_tokens"])
    ):
        return None
    dropped = ("normalizer", "pre_tokenizer", "post_processor")
    tokenizer = Tokenizer.from_str(json.dumps(spec | {k: None for k in dropped}))
    tokenizer.pre_tokenizer = CharDelimiterSplit(" ")
    held = tokenizer.get_vocab(with_added_tokens=True)
    last = np.zeros(max(held.values()) + 1, bool)
    last[[n for token, n in held.items() if token.endswith(suffix)]] = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    level = {b: chr(256 + n) for n, b in enumerate(others) if b != 32}
    return tokenizer, last, level


def _spaced(text: str) -> bytes:
    """A text in which white space parts words that can be encoded one by one.

    White space always ends a word, and a stop or comma after a letter or digit
    a part of one. The vocabulary lowers case; that is done here for A-Z, unless
    it could make a special token.
    """
    raw = text.encode("utf-8")
    if b"<|" not in raw:
        raw = raw.lower()
    return _STOP.sub(rb" \g<0>", raw)


def _strings(texts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(t) for t in texts])
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(texts))]
    return pa.LargeStringArray.from_buffers(len(texts), *buffers[1:])


# Bytes of texts that a task encodes at a time, or a longer text, and rows that it
# decodes at a time.
STEP_BYTES, STEP = 1024 * 1024, 128


def _steps(batch: pa.RecordBatch):
    """Slices of a batch whose texts hold about ``STEP_BYTES``."""
    held = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(held // STEP_BYTES)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if start < end:
            yield batch.slice(start, end - start)


def _encode(batches, path, keep, decoded=False):
    c = codec(path)
    for batch in batches:
        for rows in _steps(batch):
            ids = c.encode([t or "" for t in rows.column("text").to_pylist()])
            ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            held = pa.ListArray.from_arrays(ends, np.concatenate(ids))
            columns = [rows.column(name) for name in keep]
            columns.append(held)
            if decoded:
                columns.append(c.decode(ids))
            names = [*keep, "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _decode(batches, path, keep):
    c = codec(path)
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            rows = batch.slice(start, STEP)
            ids = [i.values.to_numpy() for i in rows.column("ids")]
            columns = [rows.column(name) for name in keep]
            columns.append(c.decode(ids))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "decoded"])


def encode_texts(
    docs: DataFrame, path: str | None = None, piece: int = PIECE, decoded: bool = False
) -> DataFrame:
    """Token ids of every whole text of ``docs`` (doc_id, text): doc_id, ids.

    With ``decoded``, the same tasks decode the ids again and add that text.

    Null and empty texts have no ids. Null doc_ids and repeated rows are kept,
    one row for each. An empty table gives no rows. Extra columns are not read.
    A text's ids are those of encoding it in one go, however long it is.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    long = F.length("text") > piece
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    whole = docs.filter(~long).mapInArrow(
        lambda it: _encode(it, path, ["doc_id"], decoded), schema
    )

    # 2^k pieces of about equal length, none above `piece`.
    n = F.length("text")
    parts = F.pow(F.lit(2), F.ceil(F.log2(n / piece))).cast("long")
    cut = docs.filter(long).select(
        "doc_id",
        F.spark_partition_id().alias("split"),
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit(1), "text").alias("k2"),
        "text",
        n.cast("long").alias("n"),
        parts.alias("parts"),
    )
    start = F.expr("part * n div parts").cast("int")
    end = F.expr("(part + 1) * n div parts").cast("int")
    cut = cut.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    ).select(
        "doc_id", "split", "k1", "k2", "part", F.substring("text", start + 1, end - start).alias("text")
    )
    # Copies of a text go to tasks by their doc_ids, repeated rows by their split.
    row = ["doc_id", "split", "k1", "k2"]
    keep = [*row, "part", "text"]
    encoded = cut.repartition(*row, "part").mapInArrow(
        lambda it: _encode(it, path, keep),
        "doc_id long, split int, k1 long, k2 long, part long, text string, ids array<int>",
    )

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        pieces = group.drop_duplicates("part").sort_values("part")
        ids = codec(path).tree(list(zip(pieces["text"], pieces["ids"])))
        rows = len(group) // len(pieces)
        doc_id = group["doc_id"].iloc[:1].astype("Int64")
        out = pd.DataFrame({"doc_id": doc_id.repeat(rows), "ids": [ids] * rows})
        if decoded:
            out["decoded"] = codec(path).decode([ids])[0].as_py()
        return out

    joined = encoded.groupBy(*row).applyInPandas(assemble, schema)
    return whole.unionByName(joined)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The decoded text for every row of ``encoded`` (doc_id, ids): adds decoded.

    No ids give an empty text. Null ids are read as none.
    """
    held = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return held.mapInArrow(
        lambda it: _decode(it, path, ["doc_id", "ids"]),
        "doc_id long, ids array<int>, decoded string",
    )

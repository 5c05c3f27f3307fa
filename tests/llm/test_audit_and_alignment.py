"""Tokenizer alignment, decontamination and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafgrid.llm import alignment, decontaminate, filter_audit
from leafgrid.llm.alignment import MEASURES, align_tokenizers
from leafgrid.llm.decontaminate import find_passages
from leafgrid.llm.filter_audit import audit_filters, audit_part, failure_masks

# Extra columns whose names the operators use inside.
CLASH = (
    "key string, chunk long, units long, groups string, copies long, total long, "
    "items string, spans string, part string, mask long, same long, id long, n long"
)
EXTRA = ("k", 1, 2, "g", 3, 4, "i", "s", "p", 5, 6, 7, 8)


def texts():
    rng = random.Random(11)
    alpha = ["a", "th", "the ", "the", " ", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x85",
             "\xa0", "▁", "é", "😀", "ﬁ", "日本", "'s", "1", "23", "<s>", "<|endoftext|>",
             "<unk>", "<0x41>", ".", ",", "Zz", "́", "﻿"]
    odd = ["".join(rng.choices(alpha, k=rng.randrange(1, 20))) for _ in range(150)]
    words = ["Word", "other", "apple", "don't", "x1", "Straße", "AND"]
    plain = [" ".join(rng.choices(words, k=30)) + rng.choice(["", "\nnext", " $"]) for _ in range(20)]
    long_ = " ".join(rng.choices(words, k=3000)) + " " * 300 + "y" * 2000
    return [None, "", " ", "\n", *odd, *plain, plain[0], plain[0], plain[1], long_, long_]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, [None, "", "a", "b"][k % 4]) for k, t in enumerate(texts())]
    # No id, a repeated row, an id with two texts, and a hot text.
    out += [(None, out[160][1], "a"), out[161], (3, "three again", "b")]
    return out + [(1000 + k, "one text of a third of all rows", "a") for k in range(120)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = f"doc_id long, text string, source string, {CLASH}"
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], schema)


def aligned(text, al):
    data = b" " + (text or "").encode()
    if not text:
        return None
    a = al.a.encode(" " + text, add_special_tokens=False).ids
    b = al.b.encode(text)
    a_end = list(itertools.accumulate(len(al.a_bytes[i]) for i in a))
    b_end = list(itertools.accumulate(len(al.b_bytes[i]) for i in b))
    if b"".join(al.a_bytes[i] for i in a) != data or b"".join(al.b_bytes[i] for i in b) != data:
        return None
    links = [
        (a[i], b[j])
        for i, (s, e) in enumerate(zip([0, *a_end], a_end))
        for j, (t, f) in enumerate(zip([0, *b_end], b_end))
        if s < f and t < e
    ]
    groups, before = [], 0
    for end in sorted(set(a_end) & set(b_end)):
        sides = [
            ",".join(str(i) for i, e in zip(ids, ends) if before < e <= end)
            for ids, ends in ((a, a_end), (b, b_end))
        ]
        groups.append("|".join(sides))
        before = end
    return len(a), len(b), groups, links


@pytest.mark.parametrize("chunk_bytes", [1, 2000, alignment.CHUNK_BYTES])
def test_alignment_equals_plain_version(spark, docs, rows, chunk_bytes):
    if chunk_bytes == 1:
        docs, rows = docs.filter("doc_id < 40"), [r for r in rows if r[0] is not None and r[0] < 40]
    # Short texts only: the plain version compares all pairs of tokens.
    docs = docs.filter("text is null or length(text) < 3000")
    rows = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    al = alignment.load()
    found = {t: aligned(t, al) for t in {r[1] for r in rows}}
    counts = Counter(p for r in rows if found[r[1]] for p in found[r[1]][3])
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    expected = []
    for id_, t, _ in rows:
        n_a, n_b, groups, links = found[t] or (0, 0, [], [])
        n_best = sum(counts[p] == most[p[1]] for p in links)
        expected.append(
            (id_, n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), ";".join(groups))
        )
    assert sum(f is None for f in found.values()) > 5
    got = align_tokenizers(docs, chunk_bytes=chunk_bytes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_units_are_encoded_as_in_their_text(monkeypatch):
    long_ = texts()[-1]
    aligner = alignment.Aligner(
        *(__import__("public_tokenizers").path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    )
    assert aligner.cut is alignment.cut_text
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 5)  # remembered units are dropped
    for run in (50, 100_000):
        monkeypatch.setattr(alignment, "RUN_CHARS", run)
        cut = aligner.chunk(0, [(b"k", t, 1) for t in texts() if t], bytes.decode)
        whole = alignment.Aligner.__new__(alignment.Aligner)
        whole.__dict__.update(aligner.__dict__, cut=lambda t: [t], known={}, older={})
        one = whole.chunk(0, [(b"k", t, 1) for t in texts() if t], bytes.decode)
        for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "weights"):
            assert cut.column(c).equals(one.column(c)), c
    assert len(long_) > 10_000


def test_measuring_forgets_remembered_units():
    """A worker that measures chunks needs no unit of those it has aligned."""
    import pyarrow as pa

    aligner = alignment.load()
    chunk = aligner.chunk(0, [(b"k", "a few words", 1)], bytes.decode)
    assert aligner.known
    left = pa.Table.from_batches([chunk])
    pairs = left["pairs"].to_pylist()[-1]
    right = pa.table({"pairs": pairs, "total": [1] * len(pairs), "best": [True] * len(pairs)})
    out = alignment._measure(left, right)
    assert out["count_sum"].to_pylist() == out["n_best"].to_pylist() == [left["n_links"].to_pylist()[0]]
    assert not aligner.known and not aligner.older


def test_alignment_of_nothing(docs):
    assert align_tokenizers(docs.filter("false")).collect() == []
    zeros = align_tokenizers(docs.filter("text is null or text = ''"), keep=lambda g: "kept")
    assert {tuple(r)[1:] for r in zeros.collect()} == {(0,) * len(MEASURES) + ("",)}


BENCH = [
    (1, "the quick brown fox jumps over the lazy dog again and again, Äpfel"),
    (2, "Short one!"),
    (3, ""),
    (4, None),
    (5, "... --"),
    (10, "SHORT\none"),
    (None, "nobody's item"),
    (1, "x x x x x x x x x x x x"),
    (7, "apple apple"),
]


def plain_passages(rows, items, words):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def lower(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    windows = defaultdict(set)
    for item, text in items:
        ws = pattern.findall(lower(text))
        for k in range(max(1, len(ws) - words + 1) if ws else 0):
            windows[tuple(ws[k : k + words])].add(item)
    out = []
    for id_, text, *_ in rows:
        ws, hit, found = pattern.findall(lower(text)), set(), set()
        for w, ids in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= {str(i) for i in ids if i is not None}
        places = [m.span() for m in pattern.finditer(lower(text))]
        covered = [places[k] for k in sorted(hit)]
        out.append((id_, len(ws), len(hit), covered, sorted(found)))
    return out


@pytest.fixture(scope="module")
def leaked(rows):
    rng = random.Random(2)
    ws = "the quick Brown fox jumps over the lazy dog again and AGAIN Äpfel x short one apple nobody s item".split()
    made = [
        (500 + k, "".join(rng.choice(ws) + rng.choice([" ", " ", "... ", "\n"]) for _ in range(40)), "a")
        for k in range(60)
    ]
    return rows + made + [(600, "é " + BENCH[0][1].upper() + "!", "a"), (601, "x " * 5000, "b")]


@pytest.mark.parametrize("limit", [400, decontaminate.AUTOMATON_BYTES])
@pytest.mark.parametrize("words", [3, 10])
def test_passages_equal_plain_search(spark, leaked, words, limit):
    schema = f"doc_id long, text string, source string, {CLASH}"
    docs = spark.createDataFrame([(*r, *EXTRA) for r in leaked], schema)
    items = spark.createDataFrame([(*b, "x") for b in BENCH], "item_id long, text string, window string")
    got = find_passages(docs, items, words, automaton_bytes=limit).collect()
    by_row = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got)
    plain = plain_passages(leaked, BENCH, words)
    assert by_row == sorted((repr(p[0]), p[1], p[2], p[4]) for p in plain)
    spans = {r["doc_id"]: r["spans"] for r in got}
    for id_, _, n_hit, covered, _ in plain:
        if id_ is not None and id_ >= 500 and id_ < 1000:
            inside = [any(s["start"] <= a and b <= s["end"] for s in spans[id_]) for a, b in covered]
            assert all(inside) and bool(spans[id_]) == bool(n_hit)
            ends = {p for s in spans[id_] for p in (("from", s["start"]), ("to", s["end"]))}
            assert ends <= {("from", a) for a, _ in covered} | {("to", b) for _, b in covered}
    assert any(p[2] for p in plain)


def test_passages_of_nothing(spark, docs):
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    assert find_passages(docs.filter("false"), items).collect() == []
    none = find_passages(docs, items.filter("false"))
    assert none.filter("n_hit > 0 or size(items) > 0 or size(spans) > 0").count() == 0
    assert none.count() == docs.count()


def test_orders_follow_by_swaps_of_neighbours():
    swaps = []
    orders = list(filter_audit.all_orders(5, swaps.append))
    assert sorted(orders) == sorted(itertools.permutations(range(5)))
    for before, after, at in zip(orders, orders[1:], swaps):
        moved = list(before)
        moved[at], moved[at + 1] = moved[at + 1], moved[at]
        assert tuple(moved) == after


def plain_audit(weighted, filters):
    out, total = {}, Counter()
    for order in itertools.permutations(range(len(filters))):
        gone = 0
        for step, f in enumerate(order):
            lost = [sum(c[k] for m, c in weighted.items() if not m & gone and m >> f & 1) for k in range(3)]
            fails = sum(c[0] for m, c in weighted.items() if m >> f & 1)
            gone |= 1 << f
            kept = sum(c[0] for m, c in weighted.items() if not m & gone)
            alone = weighted.get(1 << f, (0,))[0]
            total[f] += lost[0]
            name = "".join(filters[g] for g in order)
            out[name, step + 1] = [kept, lost[0], fails - lost[0], alone, *lost[1:], f]
    for row in out.values():
        row[-1] = total[row[-1]]
    return out


@pytest.mark.parametrize("filters", ["A", "ABC", "ABCDE"])
def test_diagram_equals_plain_audit(filters):
    rng = random.Random(4)
    for _ in range(12):
        masks = rng.sample(range(1 << len(filters)), rng.randrange(1 << len(filters)))
        weighted = {m: (n := rng.randint(1, 3), rng.randint(0, n), rng.randint(0, n)) for m in masks}
        got = {(o, s): r for o, s, *r in audit_part(weighted, filters)}
        assert got == plain_audit(weighted, filters)


def plain_masks(rows, good, toxic):
    least = {}
    for id_, text, _ in rows:
        if id_ is not None:
            least[text or ""] = min(id_, least.get(text or "", id_))
    out = defaultdict(lambda: [0, 0, 0])
    for id_, text, source in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(ws) < 50,
            100 * len(set(ws)) < 65 * len(ws),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            id_ is not None and id_ > least[t],
        ]
        held = out[source or "", sum(1 << k for k, f in enumerate(fails) if f)]
        for k, n in enumerate((1, id_ in good, id_ in toxic)):
            held[k] += n
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_plain_counts(spark, leaked, docs):
    schema = f"doc_id long, text string, source string, {CLASH}"
    docs = spark.createDataFrame([(*r, *EXTRA) for r in leaked], schema)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 200, 3)] + [(12, 0, 0), (None, 1, 1), (15, None, None)]
    says = spark.createDataFrame(
        [(i, q, None if t is None else int(t), "x") for i, q, t in labels],
        "doc_id long, quality int, toxic int, same string",
    )
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = failure_masks(docs, says)
    plain = plain_masks(leaked, good, toxic)
    got = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in masks.collect()}
    assert got == plain
    audit = audit_filters(masks).collect()
    parts = {p for p, _ in plain}
    assert len(audit) == 600 * len(parts)
    for part in parts:
        expected = plain_audit({m: c for (p, m), c in plain.items() if p == part}, "ABCDE")
        rows = {(r["filter_order"], r["step"]): list(r)[3:] for r in audit if r["part"] == part}
        assert rows == expected
    assert failure_masks(docs.filter("false"), says).collect() == []
    alone = failure_masks(docs, says.filter("false"))
    assert alone.agg(F.sum("n"), F.sum("good"), F.sum("toxic")).first() == (len(leaked), 0, 0)


def test_digest_of_groups():
    from leafgrid.llm.queries import sha256_hex

    assert sha256_hex(b"1|2") == hashlib.sha256(b"1|2").hexdigest()

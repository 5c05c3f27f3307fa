"""Chat formatting into budgeted windows.

Prefix sums of turn tokens place every turn of a conversation on a line that is
cut every ``budget - history`` tokens: a window's new turns are those that start
in its stretch, so spans are aligned to turns. A window also repeats the system
turn and the turns that start within the last ``history`` tokens before it.
Repeated turns come first and are masked; each assistant turn is a target in the
one window where it is new.

A turn is written as::

    <|im_start|>role
    text<|im_end|>

Texts can't break the template: a backslash is put after the first character of
any control string and after each backslash, and before a line feed in a role.
Taking every escape's backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import word_count
from leafgrid.scratch import store
from leafgrid.skew import prefix_sum

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common templates; none survives in an escaped text.
ESCAPED = r"\\|[<\[](?=\|im_(?:start|end)\|>|/?s>|/?INST\]|<?/?SYS>>|</SYS>>)"

_TURN = re.compile(
    re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL
)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit(r"$0\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def format_chats(convs: DataFrame, budget: int = 256, history: int = 64) -> DataFrame:
    """Windows of ``convs`` (conv_id, turn, role, text), one row per window.

    Gives conv_id, window (ascending, gaps possible), text, n_repeated (turns at
    its start that are repeated) and loss, an array of [first, last) places in
    ``text``, counted in code points: the assistant texts that are new here.

    Tokens are words plus four per turn. A turn is never cut: one that is longer
    than the budget makes its window longer. Null text and role are empty; null
    turns come first; equal turn numbers are ordered by role, then text, and
    repeated rows are turns of their own. Rows of a null conv_id are one
    conversation. An empty table gives no rows. Extra columns are not read.
    """
    stride = budget - history
    rows = convs.select(
        F.col("conv_id").isNull().alias("unnamed"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    tokens = word_count("text") + 4
    conv = ["unnamed", "conv"]
    turns = prefix_sum(rows, conv, ["turn", "role", "text"], tokens, "start", spread=True)
    turns = store(
        turns.withColumn("window", F.floor(F.col("start") / stride)), "turns"
    )
    system = turns.filter("start = 0 and role = 'system'")
    opens = F.col("start") % stride >= stride - history
    is_system = (F.col("start") == 0) & (F.col("role") == "system")
    again = turns.filter(opens & ~is_system).withColumn("window", F.col("window") + 1)
    windows = store(turns.select(*conv, "window").distinct(), "windows")
    head = (
        windows.filter("window > 0")
        .join(system.drop("window"), conv)
        .select(*turns.columns)
    )
    entries = (
        turns.withColumn("fresh", F.lit(True))
        .unionByName(again.withColumn("fresh", F.lit(False)))
        .unionByName(head.withColumn("fresh", F.lit(False)))
    )
    wrote = F.concat(
        F.lit(OPEN),
        F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")),
        F.lit("\n"),
    )
    held = F.struct("start", "fresh", "role", wrote.alias("head"), escape(F.col("text")).alias("body"))
    grouped = (
        entries.groupBy(*conv, "window")
        .agg(F.sort_array(F.collect_list(held)).alias("turns"))
        .filter(F.exists("turns", lambda t: t["fresh"]))
    )
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))
    target = lambda t: t["fresh"] & (t["role"] == "assistant") & (t["body"] != "")
    span = lambda at, t: F.struct(
        (at + F.length(t["head"])).alias("first"),
        (at + F.length(t["head"]) + F.length(t["body"])).alias("last"),
    )
    walked = F.aggregate(
        "turns",
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<first:int,last:int>>").alias("loss"),
        ),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(piece(t))).alias("at"),
            F.when(target(t), F.array_append(acc["loss"], span(acc["at"], t)))
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
    )
    return grouped.select(
        F.when(~F.col("unnamed"), F.col("conv")).alias("conv_id"),
        "window",
        F.array_join(F.transform("turns", piece), "").alias("text"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_repeated"),
        walked["loss"].alias("loss"),
    )


def digest_chats(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: one row per conversation with its digests.

    A conversation's windows pass through one task in order, since its hash is
    sequential, but one window at a time.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long",
    )


def _digest(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, done = object(), None, []

    def close():
        if state is not None:
            n, turns, chars, loss, formatted = state
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    def flush():
        return pa.RecordBatch.from_arrays(
            [
                pa.array(c, pa.string() if "sha256" in n else pa.int64())
                for n, c in zip(names, zip(*done))
            ],
            names,
        )

    for batch in batches:
        for row in batch.select(["conv_id", "text", "n_repeated", "loss"]).to_pylist():
            if state is None or row["conv_id"] != current:
                close()
                current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["text"]
            for role, said in read_turns(text)[row["n_repeated"] :]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8"))
            for span in row["loss"]:
                said = unescape(text[span["first"] : span["last"]])
                state[2] += len(said)
                state[3].update(said.encode("utf-8"))
            state[4] += len(text)
        if len(done) > 1000:
            yield flush()
            done = []
    close()
    if done:
        yield flush()

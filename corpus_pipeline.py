"""The corpus pipeline: five stages from raw documents to tokens.

Each stage reads what its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm.common import WORD, read_table
from leafgrid.llm.line_dedup import dedup_lines
from leafgrid.llm.mixing import mix_sources
from leafgrid.llm.near_dedup import near_duplicates
from leafgrid.llm.quality import fit_quality, fold, quality_score
from leafgrid.llm.queries import encoded_digests
from leafgrid.scratch import measure, store
from leafgrid.skew import prefix_sum, sized

# A document goes if its quality score is below this.
LEAST_QUALITY = 0.3


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The rows with a new text, in the order of ``columns``."""
    changed = docs.withColumn("text", text)
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", length)
    return changed.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose score is at least ``LEAST_QUALITY``.

    Null and empty texts are scored like any other, as one empty passage. Null
    doc_ids are kept if their text is good; repeated rows share their fate. An
    empty table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(fold("doc_id", 5) != 0))
    score = quality_score(spark, model)
    return docs.filter(score("text") >= LEAST_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated lines; a document left without words goes.

    Texts that are null or had no word before pass as they are, as do null
    doc_ids. Repeated rows are one document and stay alike.
    """
    carry = tuple(c for c in docs.columns if c != "text")
    # Stored before it is filtered: a filter on the rewritten text would be pushed
    # into the rewriting, where it splits the text again for every line.
    left = store(dedup_lines(docs, min_words=5, carry=carry), "lines-left")
    left = left.filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    return _with_text(left.select("carried.*", "text"), F.col("text"), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest doc_id.

    Five-word shingles, similarity 0.8 or more. Texts without words and null
    doc_ids are in no group and stay. Of rows that repeat a doc_id all stay if
    one does.
    """
    found = near_duplicates(docs, words=5, percent=80)
    gone = store(
        found.filter("not kept and doc_id is not null")
        .select(F.col("doc_id").alias("__gone"))
        .distinct(),
        "gone",
    )
    id_ = F.col("doc_id").cast("long")
    return docs.join(gone, id_ == F.col("__gone"), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each time that one is taken.

    Weights 5, 2, 1 by source, no document more than three times. Where a
    source's stream is cut the row has only the words that are taken, joined by
    blanks; all other rows have the text as it was. Null and empty texts have no
    words, so they are in no mix. Rows that agree in doc_id, text and source are
    taken each by itself.
    """
    held = store(
        docs.withColumn("__hash", F.xxhash64(F.lit(2), "doc_id", "text", "source")).withColumn(
            "__at", F.monotonically_increasing_id()
        ),
        "keyed",
    )
    # Equal hashes are numbered, so that every row has a key of its own. That is done
    # without the texts, and only numbers above 0 have to find their rows again.
    nth = prefix_sum(
        held.select("__hash", "doc_id", "__at"),
        ["__hash"],
        ["doc_id", "__at"],
        F.lit(1),
        "__nth",
        spread=True,
    )
    again, seen = measure(
        nth.filter("__nth > 0").select("__at", "__nth"),
        "again",
        size=F.count(F.lit(1)) * 40,  # of a broadcast row
    )
    held = held.join(sized(again, seen["size"]), "__at", "left")
    row = F.concat_ws("-", "__hash", F.coalesce("__nth", F.lit(0)))
    held = held.withColumn("__row", row).drop("__hash", "__at", "__nth")
    pieces = mix_sources(held.select(F.col("__row").alias("doc_id"), "text", "source"))
    # Pieces of one round follow one another: shards cut them.
    rounds = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda k: F.filter("pieces", lambda p: p["repeat"] == k),
    )
    taken = store(
        pieces.select(
            F.col("doc_id").alias("__row"),
            F.col("size").alias("__size"),
            F.explode(rounds).alias("__round"),
        )
        .filter(F.size("__round") > 0)
        .select(
            "__row",
            "__size",
            F.array_min(F.transform("__round", lambda p: p["first"])).alias("__first"),
            F.array_max(F.transform("__round", lambda p: p["last"])).alias("__last"),
        ),
        "taken",
    )
    joined = held.join(taken, "__row")
    whole = (F.col("__first") == 0) & (F.col("__last") == F.col("__size"))
    some = F.array_join(
        F.slice(
            F.regexp_extract_all("text", F.lit(f"({WORD})")),
            F.col("__first").cast("int") + 1,
            (F.col("__last") - F.col("__first")).cast("int"),
        ),
        " ",
    )
    return _with_text(
        joined, F.when(whole, F.col("text")).otherwise(some), docs.columns
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens and two hashes."""
    return encoded_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("BPE encoding", bpe_stage),
]

# Scores, signatures and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

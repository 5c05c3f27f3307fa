"""What the operators of this folder share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of anything but blank, tab, line feed, \v, \f and return.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finalizer over an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit hash for each word, the same on every machine."""
    from pandas.util import hash_array

    if not words:
        return np.empty(0, U64)
    held = np.empty(len(words), object)
    held[:] = words
    return hash_array(held, categorize=False)


def split_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case (bytes.split and lower are ASCII)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []

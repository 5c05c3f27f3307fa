"""Columns built from file names: suffix, stem, safe and numbered names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a numbered copy carries before its extension, anywhere in a name.
COPY_MARK = r" \([0-9]+\)"


def suffix(name: Column) -> Column:
    """Last extension with its dot, case kept; empty when there is none.

    A leading dot (``.env``) and a trailing dot (``file.``) start no extension.
    """
    last_part = F.regexp_extract(name, r"(?s)([^/]+)/*\z", 1)
    return F.regexp_extract(last_part, r"(?s)^.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    """``name`` without its suffix; for names that hold no ``/``."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def clean_path(path: str) -> Column:
    """A path without a leading ``./`` and without slashes at its end."""
    return F.regexp_replace(path, r"^\./|(?<=.)/+\z", "")


def safe_filename(name: Column) -> Column:
    """A single path component: no separators, NUL, outer blanks or dot names."""
    blank = r"[\s\x1c-\x1f]"
    unsafe = rf"(?U)[/\\\x00]|^{blank}|{blank}\z|^\.{{0,2}}\z"
    plain = F.regexp_replace(name, r"[/\\\x00]", "_")
    plain = F.regexp_replace(plain, rf"(?U)^{blank}+|{blank}+\z", "")
    plain = F.regexp_replace(plain, r"^\.(?=\.?\z)|(?<=^\.)\.\z", "_")
    plain = F.regexp_replace(plain, r"^\z", "file")
    # Most names are safe: one test instead of four rewrites.
    return F.when(name.rlike(unsafe), plain).otherwise(name)


def numbered(name: Column, n: Column) -> Column:
    """``stem (n).ext``; the name itself for n = 0."""
    copy = F.concat(
        stem(name), F.lit(" ("), n.cast("string"), F.lit(")"), suffix(name)
    )
    return F.when(n == 0, name).otherwise(copy)


def copy_family(name: Column) -> Column:
    """The name with every `` (n)`` taken out.

    A numbered copy always has the family of the name it was made from, so
    names of different families never compete for the same path.
    """
    return F.regexp_replace(name, COPY_MARK, "")


def copy_origins(name: Column) -> Column:
    """Every (base, n) for which ``numbered(base, n)`` is ``name``.

    The name itself is one with n = 0. A mark before the extension or at the
    very end may give another; each is kept only if numbering it leads back.
    """
    mark = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)\z"

    def origin(marked: Column, rest: Column) -> Column:
        number = F.nullif(F.regexp_extract(marked, mark, 2), F.lit(""))
        return F.struct(
            F.concat(F.regexp_extract(marked, mark, 1), rest).alias("base"),
            number.cast("long").alias("n"),
        )

    origins = F.array_distinct(
        F.array(
            F.struct(name.alias("base"), F.lit(0).cast("long").alias("n")),
            origin(stem(name), suffix(name)),
            origin(name, F.lit("")),
        )
    )
    return F.filter(
        origins, lambda o: F.coalesce(numbered(o["base"], o["n"]) == name, F.lit(False))
    )

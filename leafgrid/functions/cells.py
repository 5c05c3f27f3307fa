"""Columns of a cell grid: A1 addresses, trimming, delimited lines."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_letter(index: int) -> str:
    """Letters of a 0-based column position: 0 is A, 26 is AA."""
    if index < 0:
        raise ValueError(f"column position below zero: {index}")
    block, place = divmod(index, 26)
    head = column_letter(block - 1) if block else ""
    return head + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[place]


def letter_of(position: Column) -> Column:
    """Letters of a 0-based position column.

    Names of one, two, three letters start at 0, 26, 702, and so on; seven
    letters hold every integer position.
    """
    names, start = F.lit(None), [0]
    for width in range(1, 7):
        start.append(start[-1] + 26**width)
    for width in range(7, 0, -1):
        rest = position.cast("long") - start[width - 1]
        letters = [
            F.chr((F.floor(rest / 26**place) % 26 + 65).cast("int"))
            for place in range(width - 1, -1, -1)
        ]
        names = F.when(rest >= 0, F.concat(*letters)) if width == 7 else F.when(
            position < start[width], F.concat(*letters)
        ).otherwise(names)
    return names


def quote_tab(tab: str) -> str:
    return "'" + tab.replace("'", "''") + "'"


def quoted_tab(tab: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(tab, F.lit("'"), F.lit("''")), F.lit("'"))


class Rectangle(NamedTuple):
    """A parsed A1 range: 1-based rows, 0-based columns, None where open."""

    tab: str | None
    first_row: int | None
    last_row: int | None
    first_col: int | None
    last_col: int | None

    def a1(self, tab: str) -> str:
        """The range as A1 text on ``tab``."""
        if (self.first_row, self.last_row, self.first_col, self.last_col) == (None,) * 4:
            return quote_tab(tab)

        def corner(col: int | None, row: int | None) -> str:
            return ("" if col is None else column_letter(col)) + (
                "" if row is None else str(row)
            )

        start = corner(self.first_col, self.first_row)
        end = corner(self.last_col, self.last_row)
        return f"{quote_tab(tab)}!{start}" + ("" if start == end else f":{end}")


_CORNER = re.compile(r"([A-Za-z]{0,7})([0-9]*)")
# Letters of a column in text without a tab, where more make a name like Sheet1.
_BARE = 3


def parse_a1(text: str | None) -> Rectangle:
    """Read ``Tab!A1:C10``, ``A1:C10``, ``A2``, ``A:C``, ``2:5``, ``Tab`` or None.

    Text without ``!`` is a range when it has the form of one, else a tab name;
    a quoted name is always a tab. Columns past ZZZ are read after a tab only.
    """
    if text is None or text == "":
        return Rectangle(None, None, None, None, None)
    quoted = re.fullmatch(r"'((?:[^']|'')*)'(?:!(.*))?", text, re.DOTALL)
    if quoted:
        tab, cells = quoted.group(1).replace("''", "'"), quoted.group(2)
    elif "!" in text:
        tab, cells = text.rsplit("!", 1)
    elif _is_range(text, _BARE):
        tab, cells = None, text
    else:
        tab, cells = text, None
    if cells is None:
        return Rectangle(tab, None, None, None, None)
    if not _is_range(cells):
        raise ValueError(f"not a cell range: {text!r}")
    ends = [_corner(part) for part in cells.split(":")]
    (c1, r1), (c2, r2) = ends[0], ends[-1]
    if r1 is not None and r2 is not None and r1 > r2:
        r1, r2 = r2, r1
    if c1 is not None and c2 is not None and c1 > c2:
        c1, c2 = c2, c1
    return Rectangle(tab, r1, r2, c1, c2)


def _is_range(text: str, letters: int = 7) -> bool:
    parts = text.split(":")
    if len(parts) > 2 or not all(p and _CORNER.fullmatch(p) for p in parts):
        return False
    if any(len(_CORNER.fullmatch(p).group(1)) > letters for p in parts):
        return False
    if len(parts) == 1:
        col, row = _corner(parts[0])
        return col is not None and row is not None
    return True


def _corner(text: str) -> tuple[int | None, int | None]:
    letters, digits = _CORNER.fullmatch(text).groups()
    col = None
    if letters:
        col = 0
        for ch in letters.upper():
            col = col * 26 + ord(ch) - 64
        col -= 1
    return col, int(digits) if digits else None


def trim_cells(cells: Column) -> Column:
    """Cells up to the last non-empty one; missing values read as empty."""

    def trimmed(row: Column) -> Column:
        width = F.array_max(
            F.transform(row, lambda v, i: F.when(v != "", i + 1).otherwise(0))
        )
        return F.slice(row, 1, F.coalesce(width, F.lit(0)))

    # In an array of one, so that the cells are worked out once per row.
    kept = F.transform(F.array(cells), trimmed)[0]
    return F.transform(kept, lambda v: F.coalesce(v, F.lit("")))


def split_line(line: Column, delimiter: str = ",") -> Column:
    """Cells of one delimited line, quotes removed; a blank line has none."""
    sep = re.escape(delimiter)
    field = rf'(?<=^|{sep})("[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^{sep}]*+)'

    def unquote(cell: Column) -> Column:
        inside = F.regexp_extract(cell, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"', 1)
        after = F.substring(
            cell, F.length(inside) + 3, F.length(cell)
        )
        plain = F.concat(F.replace(inside, F.lit('""'), F.lit('"')), after)
        closed = cell.rlike(r'(?s)^"[^"]*+(?:""[^"]*+)*+"')
        return F.when(closed, plain).otherwise(cell)

    cells = F.transform(F.regexp_extract_all(line, F.lit(field), F.lit(1)), unquote)
    none = F.array().cast("array<string>")
    return F.when(line == "", none).otherwise(cells)


def ends_quoted(line: Column, delimiter: str = ",") -> Column:
    """Whether a line that starts outside quotes ends inside a quoted cell.

    For a line that starts inside one, put a quote before it.
    """
    sep = re.escape(delimiter)
    text = r'"[^"]*+(?:""[^"]*+)*+'
    closed = rf'(?:{text}"|(?!"))[^{sep}]*+{sep}'
    return line.rlike(rf"(?s)\A(?:{closed})*+{text}\z")


def join_line(cells: Column, delimiter: str = ",") -> Column:
    """One delimited line: only cells that need quotes get them."""

    def quote(cell: Column) -> Column:
        text = F.coalesce(cell, F.lit(""))
        doubled = F.concat(
            F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')
        )
        special = text.rlike(rf'["\r\n{re.escape(delimiter)}]')
        return F.when(special, doubled).otherwise(text)

    line = F.array_join(F.transform(cells, quote), delimiter)
    lone_blank = (F.size(cells) == 1) & (line == "")
    return F.when(lone_blank, F.lit('""')).otherwise(line)

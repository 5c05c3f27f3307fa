"""Columns of a file record: type, url, owner, date, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrid.functions.names import suffix

# MIME types with a short label.
MIME_LABELS = {
    "application/vnd.google-apps.folder": "folder",
    "application/vnd.google-apps.document": "gdoc",
    "application/vnd.google-apps.spreadsheet": "gsheet",
    "application/vnd.google-apps.presentation": "gslides",
    "application/vnd.google-apps.form": "gform",
    "application/vnd.google-apps.drawing": "gdrawing",
    "application/vnd.google-apps.site": "gsite",
    "application/vnd.google-apps.jam": "gjam",
    "application/vnd.google-apps.script": "gscript",
    "application/vnd.google.colaboratory": "colab",
    "application/vnd.google-apps.map": "gmap",
    "application/vnd.google-apps.shortcut": "shortcut",
}
FOLDER_MIME = "application/vnd.google-apps.folder"
NATIVE_PREFIX = "application/vnd.google-apps."

# Export extension of a native type, and MIME type of an extension.
EXPORT_EXTENSIONS = {
    "application/vnd.google-apps.document": ".docx",
    "application/vnd.google-apps.spreadsheet": ".xlsx",
    "application/vnd.google-apps.presentation": ".pptx",
}
EXPORT_MIME_TYPES = {
    ".csv": "text/csv",
    ".docx": "application/vnd.openxmlformats-officedocument"
    ".wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument"
    ".presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}

# Addresses.
MY_DRIVE_URL = "https://drive.google.com/drive/my-drive"
FOLDER_URL = "https://drive.google.com/drive/folders/"
FILE_URL = "https://drive.google.com/file/d/"
CANONICAL_HOSTS = ("drive.google.com", "docs.google.com")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a fixed table, null when it has none."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def is_folder(mime: Column | str = "mimeType") -> Column:
    """Never null, and pushed down to a Parquet scan when filtered on."""
    return _col(mime).eqNullSafe(FOLDER_MIME)


def is_native(mime: Column | str = "mimeType") -> Column:
    return F.coalesce(_col(mime).startswith(NATIVE_PREFIX), F.lit(False))


def is_live() -> Column:
    return ~F.col("trashed").eqNullSafe(True)


def file_type(mime: Column | str = "mimeType", name: Column | str = "name") -> Column:
    extension = F.ltrim(suffix(_col(name)), F.lit("."))
    return F.coalesce(
        lookup(MIME_LABELS, _col(mime)),
        F.nullif(extension, F.lit("")),
        F.lit("unknown"),
    )


def modified_date(ts: Column | str = "modifiedTime") -> Column:
    """Calendar date in the timestamp's own offset: the text before the ``T``.

    Empty where that is no date, see ``is_malformed_time``.
    """
    return F.coalesce(_date_of(ts).cast("string"), F.lit(""))


def is_malformed_time(ts: Column | str = "modifiedTime") -> Column:
    filled = F.length(_col(ts)) > 0
    return F.coalesce(filled & _date_of(ts).isNull(), F.lit(False))


def _date_of(ts: Column | str) -> Column:
    dated = _col(ts).rlike(r"^\d{4}-\d\d-\d\d")
    return F.when(dated, F.substring(_col(ts), 1, 10).try_cast("date"))


def owner_email() -> Column:
    return F.coalesce(F.get("owners", F.lit(0))["emailAddress"], F.lit(""))


def shared_by() -> Column:
    return F.coalesce(F.col("sharingUser.emailAddress"), F.lit(""))


def strip_url_suffix(url: Column) -> Column:
    ours = F.contains(url, F.lit(CANONICAL_HOSTS[0])) | F.contains(
        url, F.lit(CANONICAL_HOSTS[1])
    )
    bare = F.when(ours, F.substring_index(url, "?", 1)).otherwise(url)
    bare = F.regexp_replace(bare, r"/edit\z", "")
    return F.regexp_replace(bare, r"/view\z", "")


def file_url() -> Column:
    own = F.coalesce(F.col("webViewLink"), F.concat(F.lit(FILE_URL), F.col("id")))
    return F.when(is_folder(), F.concat(F.lit(FOLDER_URL), F.col("id"))).otherwise(
        strip_url_suffix(own)
    )


def is_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def extract_id(text: Column) -> Column:
    """Id inside a link, or the text itself; null for a link without an id."""
    in_path = F.nullif(
        F.regexp_extract(text, r"/(?:folders|d)/([a-zA-Z0-9_-]+)", 1), F.lit("")
    )
    in_query = F.nullif(
        F.regexp_extract(text, r"[?&]id=([a-zA-Z0-9_-]+)", 1), F.lit("")
    )
    return F.coalesce(in_path, in_query, F.when(~is_url(text), text))


def sort_struct() -> Column:
    """Folders first, then case-insensitive name; the id settles ties."""
    return F.struct(
        (~is_folder()).alias("is_file"),
        F.lower("name").alias("lname"),
        F.col("id").alias("id"),
    )


def size_in_bytes(size: Column | str = "size") -> Column:
    """Whole-number text to BIGINT; anything else counts as 0 bytes."""
    return F.coalesce(_whole_number(size), F.lit(0))


def is_malformed_size(size: Column | str = "size") -> Column:
    filled = F.length(_col(size)) > 0
    return F.coalesce(filled & _whole_number(size).isNull(), F.lit(False))


def _whole_number(text: Column | str) -> Column:
    whole = F.regexp_extract(_col(text), r"^\s*([+-]?[0-9]+(?:_[0-9]+)*)\s*\z", 1)
    return F.replace(whole, F.lit("_"), F.lit("")).try_cast("long")


def format_bytes(n: Column) -> Column:
    """Bytes in the largest fitting unit, one decimal, exact ties to even.

    The tenths are counted in whole numbers: rounding the quotient as text or as
    a double takes some values near a tie the wrong way. ``n`` may be a decimal or
    a double beyond the range of BIGINT, below 2**113.
    """
    value = n.cast("double")
    size = F.coalesce(value.try_cast("long"), n.try_cast("long"))
    out = F.when(size < 1024, F.concat(_tenths(size, 0), F.lit(" B")))
    for power, unit in enumerate((" KB", " MB", " GB", " TB"), start=1):
        text = F.concat(_tenths(size, power), F.lit(unit))
        out = out.when(size < 1024 ** (power + 1), text)
    out = out.otherwise(F.concat(_tenths(size, 5), F.lit(" PB")))
    return F.coalesce(out, _beyond_long(value))


def _beyond_long(value: Column) -> Column:
    """Petabytes of a double that no BIGINT holds: whole ones and a rest, both exact."""
    unit = 1024**5
    count = F.when((value > 0) & (value < 2.0**63 * unit), value / unit)
    whole = F.floor(count)
    tenths = _count_tenths(((count - whole) * unit).cast("long"), 5)
    return F.concat(whole + F.floor(tenths / 10), F.lit("."), tenths % 10, F.lit(" PB"))


def _tenths(size: Column, power: int) -> Column:
    tenths = _count_tenths(size, power)
    return F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10)


def _count_tenths(size: Column, power: int) -> Column:
    unit = 1024**power
    part = size.bitwiseAND(unit - 1) * 10
    whole = F.shiftright(size, 10 * power) * 10 + F.shiftright(part, 10 * power)
    rest = part.bitwiseAND(unit - 1) * 2
    up = (rest > unit) | ((rest == unit) & (whole % 2 == 1))
    return whole + up.cast("long")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

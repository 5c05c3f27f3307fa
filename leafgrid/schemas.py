"""Explicit schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

PERSON = StructType(
    [
        StructField("displayName", StringType()),
        StructField("emailAddress", StringType()),
    ]
)

# One file or folder. Sizes and times stay text, as the service sends them.
FILE = StructType(
    [
        StructField("id", StringType()),
        StructField("name", StringType()),
        StructField("mimeType", StringType()),
        StructField("size", StringType()),
        StructField("webViewLink", StringType()),
        StructField("modifiedTime", StringType()),
        StructField("owners", ArrayType(PERSON)),
        StructField("sharingUser", PERSON),
        StructField("parents", ArrayType(StringType())),
        StructField("trashed", BooleanType()),
        StructField("sharedWithMeTime", StringType()),
        StructField("driveId", StringType()),
    ]
)

FILE_PAGE = StructType(
    [
        StructField("files", ArrayType(FILE)),
        StructField("nextPageToken", StringType()),
    ]
)

DRIVE = StructType(
    [
        StructField("id", StringType()),
        StructField("type", StringType()),
        StructField("name", StringType()),
        StructField("url", StringType()),
    ]
)

# Catalog order decides which of two equally named drives is found.
DRIVE_CATALOG = StructType([*DRIVE.fields, StructField("ord", LongType())])

GRID = StructType(
    [
        StructField("tab", StringType()),
        StructField("tab_ord", IntegerType()),
        StructField("row_num", LongType()),
        StructField("cells", ArrayType(StringType())),
    ]
)

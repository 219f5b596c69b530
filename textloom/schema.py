"""Schemas of rows that the engine makes and reads."""

from __future__ import annotations

from pyspark.sql import types as T

#: A file as it is found and read; content or error is null.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("ext", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
#: A file's statistics, and a snapshot's row.
FILE_STATS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("lines", T.LongType()),
        T.StructField("chars", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("sloc", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("ext", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("is_binary", T.BooleanType()),
    ]
)
ERRORS = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])

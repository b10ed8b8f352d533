"""Row types of the tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType()),
])

# one structural block of a file, before it gets its path and position
BLOCK_DDL = "struct<kind:string,name:string,text:string,annotations:array<string>>"
BLOCKS_DDL = f"array<{BLOCK_DDL}>"

ANSWER = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("neededFiles", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("searchForUsage", T.StructType([
        T.StructField("regex", T.StringType()),
        T.StructField("flags", T.StringType()),
        T.StructField("fileTypes", T.ArrayType(T.StringType())),
    ])),
    T.StructField("_corrupt", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

"""Helpers that the operators of this folder share: stored steps, partitions, digests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import scratch_path

#: What separates words: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    For steps that several later jobs read: a lost executor then costs a re-read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which follows the data's size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: Bits of the filter of keys below: a fixed size, 2 MB.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame) -> bytes:
    """A bit for each value of the long column ``key``: as many numbers at most as the fixed
    size has, however many keys there are. Keys that are not in the table may pass; they cost
    work, not results."""
    at = F.expr(f"key & {FILTER_BITS - 1}")
    words = keys.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b"))
    found = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    rows = found.toArrow()
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return table.tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each of the keys."""
    at = keys.astype(np.int64) & (FILTER_BITS - 1)
    word = np.frombuffer(bits, "<u8")[at >> 6]
    return (word >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

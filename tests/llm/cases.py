"""Rows with every odd case: nulls, empty and blank texts, repeated rows, ties, long texts,
columns whose names clash with those the operators make."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string,"
          " row string, size int, range int, kept string")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(4000))
BASE = " ".join(f"word{i}" for i in range(60))


def rows() -> list[tuple]:
    texts = [
        (1, BASE), (2, BASE), (3, BASE.replace("word7 ", "other ")), (4, BASE.upper()),
        (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "one  two"), (10, "one\ntwo"),
        (11, LONG), (12, LONG + " end"), (13, "x" * 3000), (14, "é" * 2000),
        (15, "a line of words that is here\na line of words that is here\n" + BASE),
        (16, "<|endoftext|> and 日本語 İ ẞ"), (17, "12 34 ..."), (17, BASE + " tail"),
        (None, BASE), (None, None), (18, "one two"), (18, "one two"),
    ]
    langs, sources = ("en", "de", None), ("s1", None, "s0", "s2")
    return [(i, t, langs[k % 3], sources[k % 4], None, "k", "r", k, 3, "x")
            for k, (i, t) in enumerate(texts)]


def frame(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def documents(spark, sf_dir: str = "/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

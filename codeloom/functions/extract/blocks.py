"""Helpers to build arrays of blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schemas import BLOCKS_DDL


def no_blocks() -> Column:
    return F.array().cast(BLOCKS_DDL)


def block(kind: str, name: Column | None, text: Column, annotations: Column | None = None):
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(None) if name is None else name).cast("string").alias("name"),
        text.alias("text"),
        (F.array() if annotations is None else annotations)
        .cast("array<string>").alias("annotations"),
    )


def matches(content: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def as_blocks(kind: str, texts: Column, name=None) -> Column:
    """One block per text; ``name`` maps a text to its declared name."""
    return F.transform(texts, lambda t: block(kind, name(t) if name else None, t)).cast(BLOCKS_DDL)


def texts_of(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["text"])


def block_group(texts: Column, separator: str = "\n") -> Column:
    """The texts as one paragraph, or no paragraph when there are none."""
    return F.filter(F.array(F.array_join(texts, separator)), lambda joined: joined != "")


def paragraphs(*groups: Column) -> Column:
    return F.array_join(F.concat(*groups), "\n\n")

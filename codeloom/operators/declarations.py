"""Declaration index over a corpus, structural summaries and own extractors."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.extract import html, java, javascript, typescript
from codeloom.functions.extract.blocks import no_blocks, texts_of
from codeloom.functions.paths import extension
from codeloom.schemas import BLOCK_DDL, BLOCKS_DDL

Extractor = Callable[[Column], Column]



class Extractors(NamedTuple):
    """Columns that find the blocks of a file, and its short form, by extension."""

    blocks: dict[str, Extractor]
    summaries: dict[str, Extractor]

    def adding(
        self, ext: str, blocks: Extractor, summary: Extractor | None = None
    ) -> Extractors:
        """These and one for files ending in ``ext``; the ones at hand stay as they are.

        ``blocks`` maps the content column to an array of (kind, name, text). Its rows join
        the declaration index; without ``summary`` a file is summarised by its blocks' texts.
        """
        ext = ext.lower()

        def full(content: Column) -> Column:
            return F.transform(
                blocks(content),
                lambda b: F.struct(
                    b["kind"].alias("kind"), b["name"].alias("name"), b["text"].alias("text"),
                    F.array().cast("array<string>").alias("annotations"),
                ).cast(BLOCK_DDL),
            ).cast(BLOCKS_DDL)

        short = summary or (lambda c: F.array_join(texts_of(full(c)), "\n\n"))
        return Extractors(self.blocks | {ext: full}, self.summaries | {ext: short})


BUILT_IN = Extractors(
    {
        ".ts": typescript.blocks, ".js": javascript.blocks, ".java": java.blocks,
        ".html": html.blocks, ".htm": html.blocks, ".jsp": html.blocks,
    },
    {
        ".ts": typescript.summary, ".js": javascript.summary, ".java": java.summary,
        ".html": html.summary, ".htm": html.summary, ".jsp": html.summary,
    },
)


def _dispatch(path: Column, content: Column, table: dict[str, Extractor], default: Column):
    ext = F.lower(extension(path))
    shared: dict[Extractor, list[str]] = {}
    for name, fn in table.items():
        shared.setdefault(fn, []).append(name)
    result = None
    for fn, names in shared.items():
        condition = ext.isin(*names)
        result = F.when(condition, fn(content)) if result is None else result.when(
            condition, fn(content))
    return result.otherwise(default)


def blocks_of(path: Column, content: Column, extractors: Extractors = BUILT_IN) -> Column:
    """Blocks by the extractor of the path's extension; none for unknown ones."""
    return _dispatch(path, content, extractors.blocks, no_blocks())


def structural_summary(
    path: Column, content: Column, extractors: Extractors = BUILT_IN
) -> Column:
    """Short form of a file; content of an unknown extension passes through."""
    return _dispatch(path, content, extractors.summaries, content)


def explode_blocks(files: DataFrame, blocks: Column) -> DataFrame:
    """One row per block: (path, pos, kind, name, text, annotations)."""
    return files.select("path", F.posexplode(blocks).alias("pos", "block")).select(
        "path", "pos", "block.*"
    )


def declaration_index(files: DataFrame, extractors: Extractors = BUILT_IN) -> DataFrame:
    return explode_blocks(files, blocks_of(F.col("path"), F.col("content"), extractors))


def summarized(files: DataFrame, extractors: Extractors = BUILT_IN) -> DataFrame:
    """(path, summary) of each file."""
    return files.select(
        "path",
        structural_summary(F.col("path"), F.col("content"), extractors).alias("summary")
    )

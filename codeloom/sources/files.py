"""Files as rows: listing, reading, requested reads, bundles."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.filters import PathFilter, has_extension, path_kept
from codeloom.functions.text import file_entry
from codeloom.operators.declarations import structural_summary
from codeloom.sources.tree import local_folder, read_tree, walk

NOT_FOUND = "not found"


def on_mounted(spark: SparkSession, directory: str) -> bool:
    """Whether tasks can open the folder by its path."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return directory.startswith("file:") or "://" not in directory and default.startswith("file:")


def _empty_files(spark: SparkSession, scanned: DataFrame, base: str) -> DataFrame:
    """Files without content, which Spark's scans leave out. On a mounted file system tasks
    list them; else they are the names in the file index of the scan that it does not return."""
    if on_mounted(spark, base):
        return walk(spark, base).filter("size = 0").select(
            F.concat(F.lit(f"file:{local_folder(base).rstrip('/')}/"), "path").alias("path"),
            F.col("size").alias("length"), F.lit(b"").alias("content"))
    names = [(unquote(name),) for name in scanned.inputFiles()]
    listed = spark.createDataFrame(names, "path string")

    def plain(path: str) -> Column:
        # index and scan may write the empty authority of a path differently
        return F.regexp_replace(path, r"^(\w+):/+", "$1:/").alias("path")

    return listed.select(plain("path")).join(
        scanned.select(plain("path")), "path", "left_anti"
    ).select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def _scan(
    spark: SparkSession, directory: str, empty_files: bool, glob: str | None = None
) -> tuple[DataFrame, str]:
    """Binary scan with the path made relative; content is only read when selected."""
    base = directory.rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = os.path.abspath(base)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    bare = base.split(":", 1)[1].lstrip("/") if ":" in base.split("/", 1)[0] else base.lstrip("/")
    start = F.position(F.lit(f"/{bare}/"), F.col("path"))
    relative = F.substring("path", start + len(bare) + 2, F.length("path"))
    scanned = reader.load(base).select("path", "length", "content")
    if empty_files:
        scanned = scanned.unionByName(_empty_files(spark, scanned, base))
    return scanned.withColumn("path", relative), base


def list_files(
    spark: SparkSession, directory: str, include: PathFilter = None,
    exclude: PathFilter = None, empty_files: bool = True,
) -> DataFrame:
    """(path, size) below ``directory``. Text filters see the relative path, pattern
    filters see the folder too.

    Empty files are listed by tasks on a mounted file system (``tree.walk``); in other stores
    the names of all files go through the driver. ``empty_files=False`` spares either.
    """
    files, base = _scan(spark, directory, empty_files)
    return files.filter(path_kept(F.col("path"), include, exclude, base)).select(
        "path", F.col("length").alias("size")
    )


def list_by_extension(
    files: DataFrame, extensions: Sequence[str] = (), case_sensitive: bool = False
) -> DataFrame:
    return files.filter(has_extension(F.col("path"), extensions, case_sensitive))


def _name_pattern(extensions: Sequence[str]) -> str | None:
    """Glob for names that end in one of ``extensions``, upper or lower case."""
    if not extensions or not all(re.fullmatch(r"\.\w+", e, re.ASCII) for e in extensions):
        return None
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
              for e in extensions]
    return "*{" + ",".join(either) + "}"


def read_files(
    spark: SparkSession, directory: str, extensions: Sequence[str] = (),
    include: PathFilter = None, exclude: PathFilter = None, empty_files: bool = True,
) -> DataFrame:
    """(path, size, content) with invalid UTF-8 replaced. Extensions, in any case, are also
    given to the scan as a name pattern, so that other files are not even opened."""
    files, base = _scan(spark, directory, empty_files, _name_pattern(extensions))
    return files.filter(
        path_kept(F.col("path"), include, exclude, base)
        & has_extension(F.col("path"), extensions)
    ).select(
        "path", F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def read_requested(requests: DataFrame, files: DataFrame, missing: str = "error") -> DataFrame:
    """Add ``content`` and ``error`` to requested paths. A path that is no file gives a row
    with an error, or no row with ``missing="skip"``."""
    if missing not in ("error", "skip"):
        raise ValueError("missing must be 'error' or 'skip'")
    # contents of other files are dropped before the join, so they are not shuffled
    known = files.select("path", "content", F.lit(True).alias("_known")).join(
        requests.select("path").distinct(), "path", "left_semi"
    )
    how = "left" if missing == "error" else "inner"
    return requests.join(known, "path", how).withColumn(
        "error", F.when(F.col("_known").isNull(), F.lit(NOT_FOUND))
    ).drop("_known")


def read_requested_from(
    spark: SparkSession, requests: DataFrame, directory: str, missing: str = "error"
) -> DataFrame:
    """Requested paths (path, ...) with ``content`` and ``error``; opens requested files only,
    each once."""
    return read_requested(requests, read_tree(spark, directory, hidden=True, only=requests), missing)


def read_summarized(files: DataFrame) -> DataFrame:
    """``content`` replaced by the structural summary."""
    return files.withColumn("content", structural_summary(F.col("path"), F.col("content")))


def render_bundle(
    rows: DataFrame, bundle: str = "bundle_id", position: str = "position",
    per_part: int = 64,
) -> DataFrame:
    """(bundle, part, text): files of a bundle as one text, in position order.

    A bundle of any length is cut into parts of ``per_part`` positions; the texts of its
    parts, joined by a newline and an empty line, are the bundle.
    """
    shown = F.coalesce("content", F.concat(F.lit("Error: "), "error"))
    entry = file_entry(F.col("path"), shown)
    entries = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"),
                                                   entry.alias("text"))))
    return rows.groupBy(
        bundle, F.floor(F.col(position) / per_part).cast("long").alias("part")
    ).agg(F.array_join(F.transform(entries, lambda e: e["text"]), "\n\n").alias("text"))

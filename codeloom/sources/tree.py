"""Folders walked, files opened and written by tasks; no name passes through the driver.

For trees below a folder that all executors can open by path (a mounted file system). Trees in
other stores are listed and read by Spark's own scan (``files``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.filters import PathFilter, has_extension, path_kept
from codeloom.operators.chunks import search_chunks
from codeloom.operators.search import fuzzy_search
from codeloom.session import cut_lineage

#: Entries that a task lists before it hands its remaining folders to the next job.
ENTRIES_AT_ONCE = 20_000
_ENTRY = "path string, folder boolean, size long"


def local_folder(directory: str) -> str | None:
    """The plain path of a folder on a mounted file system, None for other stores."""
    if directory.startswith("file:"):
        return "/" + directory[len("file:"):].lstrip("/")
    return None if "://" in directory else os.path.abspath(directory)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def walk(spark: SparkSession, directory: str, hidden: bool = False) -> DataFrame:
    """(path, size) of all files below ``directory``, empty ones too; with ``hidden`` those
    whose name, or whose folder's name, begins with ``_`` or ``.`` as well.

    A job lists a level of folders, one folder per row, spread over tasks. A task goes down
    its own folders until it has ``ENTRIES_AT_ONCE`` entries and leaves the rest to the next
    job, so a small tree takes one job and the jobs of a large one follow its depth at most.
    Links to folders are not followed, so no folder is listed twice. A folder that cannot be
    read has no files.
    """
    base = local_folder(directory)
    if base is None:
        raise ValueError(f"{directory} is not on a mounted file system")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t)
                 for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))],
                ["path", "folder", "size"])

        for batch in batches:
            todo, rows, seen = batch.column(0).to_pylist(), [], 0
            while todo:
                if seen >= ENTRIES_AT_ONCE:  # others go on with these
                    yield pack([(folder, True, None) for folder in todo])
                    break
                folder = todo.pop()
                try:
                    entries = os.scandir(os.path.join(base, folder))
                except OSError:
                    continue
                with entries:
                    for entry in entries:
                        seen += 1
                        if not hidden and entry.name[0] in "_.":
                            continue
                        path = os.path.join(folder, entry.name)
                        if entry.is_dir(follow_symlinks=False):
                            todo.append(path)
                        elif entry.is_file():
                            rows.append((path, False, entry.stat().st_size))
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
            if rows:
                yield pack(rows)

    folders = spark.createDataFrame([("",)], "path string")
    files = None
    while True:
        entries = cut_lineage(folders.mapInArrow(listed, _ENTRY))
        found = entries.filter("NOT folder").select("path", "size")
        files = found if files is None else files.unionByName(found)
        left = entries.filter("folder").select("path")
        if left.isEmpty():
            return files
        folders = left.repartition(_partitions(spark))


def with_content(paths: DataFrame, directory: str) -> DataFrame:
    """``paths`` (path, ...) with ``content``: each row's file is opened, no other one.
    Invalid UTF-8 is replaced; a file that cannot be read has null."""
    base = local_folder(directory)
    if base is None:
        raise ValueError(f"{directory} is not on a mounted file system")
    place = paths.columns.index("path")

    def read(path: str) -> str | None:
        try:
            with open(os.path.join(base, path), "rb") as file:
                return file.read().decode("utf-8", "replace")
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(place).to_pylist()
            for at, name in enumerate(names):  # one file at a time in memory
                content = None if name is None else read(name)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, 1).columns, pa.array([content], pa.string())],
                    [*batch.schema.names, "content"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInArrow(run, f"{ddl}, content string")


def write_folders(rows: DataFrame, directory: str) -> None:
    """Rows (folder, value) as text files, one file in each folder below ``directory``: its
    values, each with a newline after it.

    Rows meet by folder in a shuffle, and every task writes the files of its own folders. A file
    gets its name when it is whole, so a task that runs again replaces it. No list of files is
    committed by the driver, which otherwise moves folder after folder.
    """
    base = local_folder(directory)
    if base is None:
        raise ValueError(f"{directory} is not on a mounted file system")
    os.makedirs(base, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, unnamed = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                os.rename(unnamed, os.path.join(base, at, "part-00000.txt"))

        try:
            for batch in batches:
                for folder, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if folder != at:
                        close()
                        at, out = folder, None
                        os.makedirs(os.path.join(base, at), exist_ok=True)
                        unnamed = os.path.join(base, at, f".part-{uuid.uuid4().hex}")
                        out = open(unnamed, "wb")
                    out.write((value.as_py() or "").encode() + b"\n")
            close()
            out = None
        finally:
            if out is not None and not out.closed:
                out.close()
        yield from ()

    (
        rows.select("folder", "value").repartition(_partitions(rows.sparkSession), "folder")
        .sortWithinPartitions("folder").mapInArrow(run, "done boolean")
        .write.format("noop").mode("overwrite").save()
    )


def read_tree(
    spark: SparkSession, directory: str, extensions: Sequence[str] = (),
    include: PathFilter = None, exclude: PathFilter = None, hidden: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """(path, size, content) below ``directory``. Filters, and the paths of ``only`` if given,
    choose before anything is opened."""
    base = local_folder(directory)
    chosen = walk(spark, directory, hidden).filter(
        path_kept(F.col("path"), include, exclude, base) & has_extension(F.col("path"), extensions))
    if only is not None:
        chosen = chosen.join(only.select("path").distinct(), "path", "left_semi")
    return with_content(chosen, directory)


def search_chunks_from(
    spark: SparkSession, directory: str, query: str, top_n: int = V.DEFAULT_TOP_N,
    split: str = "lines"
) -> DataFrame:
    """(rank, path, chunk_index, chunk) of the best files by name; opens these only."""
    listed = walk(spark, directory)
    best = cut_lineage(fuzzy_search(listed.select("path"), query, top_n).select("path"))
    return search_chunks(with_content(best, directory), query, top_n, split)

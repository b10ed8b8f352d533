"""Import links: extraction, resolution against the files, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.paths import directory, join_paths, normalize_path
from codeloom.functions.text import is_local_specifier


def link_specifiers(content: Column) -> Column:
    """Quoted targets of one-line ``import`` statements, in order."""
    return F.regexp_extract_all(content, F.lit(V.IMPORT_TARGET), F.lit(1))


def classify(spec: Column) -> dict[str, Column]:
    relative = spec.startswith(".")
    library = ~is_local_specifier(spec)
    return {
        "is_relative": relative,
        "is_library": library,
        "link_class": F.when(relative, "relative").when(library, "library").otherwise("absolute"),
    }


def extract_links(files: DataFrame) -> DataFrame:
    """(src, pos, spec, is_relative, is_library, link_class), one row per import."""
    links = files.select(
        F.col("path").alias("src"),
        F.posexplode(link_specifiers(F.col("content"))).alias("pos", "spec"),
    )
    return links.withColumns(classify(F.col("spec")))


def _known_targets(files: DataFrame) -> DataFrame:
    """What can be asked for: each path itself, and each path without .ts / .js."""
    path = F.col("path")
    bare = F.substring(path, F.lit(1), F.length(path) - 3)
    ts, js = path.endswith(".ts"), path.endswith(".js")
    asked = F.array(
        F.struct(path.alias("target"), F.lit(True).alias("exact"),
                 F.lit(False).alias("ts"), F.lit(False).alias("js")),
        F.struct(F.when(ts | js, bare).alias("target"), F.lit(False).alias("exact"),
                 ts.alias("ts"), js.alias("js")),
    )
    return (
        files.select(F.inline(asked))
        .filter(F.col("target").isNotNull())
        .groupBy("target")
        .agg(*[F.max(c).alias(c) for c in ("exact", "ts", "js")])
    )


def resolve_links(links: DataFrame, files: DataFrame, base: str = "importer") -> DataFrame:
    """Add ``dst`` and ``resolved``.

    A relative specifier without .ts / .js gets the first of these under which a file
    exists, else stays as it is. ``base="importer"`` resolves against the folder of the
    importing file, ``base="root"`` against the root folder (one file may then appear
    under several names).

    One join on the wanted path. Links that are not relative cannot match, so their key is
    unique per link instead of one shared NULL that would fill a single task. A target that
    many files import makes the left side uneven; the right side has one row per key, so
    Spark's skew join can split such a key over tasks.
    """
    if base not in ("importer", "root"):
        raise ValueError("base must be 'importer' or 'root'")
    spec = F.col("spec")
    root = F.regexp_replace(spec, r"^\./", "")
    probe = normalize_path(spec) if base == "root" else join_paths(directory(F.col("src")), spec)
    unmatched = F.concat(F.lit("\0"), F.col("src"), F.lit("\0"), F.col("pos"))
    # only the key is carried through the join, what is wanted follows from it
    keyed = links.withColumn("_probe", F.when(F.col("is_relative"), probe).otherwise(unmatched))
    probes = ~spec.endswith(".ts") & ~spec.endswith(".js")
    found = keyed.join(
        _known_targets(files).withColumnRenamed("target", "_probe"), "_probe", "left"
    )
    wanted = F.when(F.col("is_relative"), root if base == "root" else F.col("_probe"))
    found = found.withColumn("_wanted", wanted.otherwise(spec))
    dst = (
        F.when(probes & F.col("ts"), F.concat("_wanted", F.lit(".ts")))
        .when(probes & F.col("js"), F.concat("_wanted", F.lit(".js")))
        .otherwise(F.col("_wanted"))
    )
    exists = F.col("exact") | (probes & (F.col("ts") | F.col("js")))
    return found.withColumn("dst", dst).withColumn(
        "resolved", F.coalesce(exists, F.lit(False))
    ).select(*links.columns, "dst", "resolved")


def import_edges(
    files: DataFrame, base: str = "importer", known: DataFrame | None = None
) -> DataFrame:
    """Links of all files, resolved against the paths of ``known`` (else of ``files``)."""
    return resolve_links(extract_links(files), files if known is None else known, base)

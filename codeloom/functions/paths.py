"""Path columns: extension, stem, join, normalise, relativise, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.text import let


def extension(path: Column) -> Column:
    """Extension with its dot; ``x.d.ts`` gives ``.ts``, dot files give ``''``."""
    return F.regexp_extract(path, r"(?:^|/)(?!\.\.$)[^/]+(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def directory(path: Column) -> Column:
    """Everything before the last slash, ``''`` for a bare name."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def _fold(path: Column, absolute: Column) -> Column:
    """Segments of ``path`` with ``.`` dropped and ``..`` taking its parent away."""

    def step(kept: Column, part: Column) -> Column:
        parent_known = F.get(kept, F.size(kept) - 1) != ".."  # NULL when none is left
        return (
            F.when(part.isin("", "."), kept)
            .when((part == "..") & parent_known, F.slice(kept, 1, F.size(kept) - 1))
            .when((part == "..") & absolute, kept)
            .otherwise(F.array_append(kept, part))
        )

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


_PARENT_STEP = r"(^|/)(?!\.{1,2}/)[^/]+/\.\./(?=[^/])"  # a folder and the way back out of it
_TO_FOLD = r"(^|/)\.{0,2}(/|$)"  # segments that are empty, ``.`` or ``..``


def normalize_path(path: Column) -> Column:
    """Fold ``.`` and ``..``; a relative path keeps the ``..`` it cannot resolve.

    Most paths are done after one replacement; only the others are folded by segment.
    """
    return let(
        F.regexp_replace(path, _PARENT_STEP, "$1"),
        lambda p: F.when(p.rlike(_TO_FOLD), _folded(p)).otherwise(p),
    )


def _folded(path: Column) -> Column:
    absolute = path.startswith("/")

    def shown(body: Column) -> Column:
        tail = F.when(path.endswith("/") & (body != ""), "/").otherwise("")
        return (
            F.when(absolute, F.concat(F.lit("/"), body, tail))
            .when(body == "", F.when(path.endswith("/"), "./").otherwise("."))
            .otherwise(F.concat(body, tail))
        )

    return let(F.array_join(_fold(path, absolute), "/"), shown)


def join_paths(*parts: Column) -> Column:
    """Join non-empty parts with ``/`` and normalise."""
    return let(
        F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts]), normalize_path
    )


def relative_path(base: Column, path: Column) -> Column:
    """Path that leads from folder ``base`` to ``path`` (both absolute or both relative)."""

    def lead(ends: Column) -> Column:
        source, target = ends["source"], ends["target"]
        shared = F.aggregate(
            F.arrays_zip(source.alias("s"), target.alias("t")),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
            lambda seen, pair: F.when(
                seen["same"] & pair["s"].eqNullSafe(pair["t"]),
                F.struct((seen["n"] + 1).alias("n"), F.lit(True).alias("same")),
            ).otherwise(F.struct(seen["n"].alias("n"), F.lit(False).alias("same"))),
            lambda seen: seen["n"],
        )
        return let(shared, lambda n: F.array_join(F.concat(
            F.array_repeat(F.lit(".."), F.size(source) - n),
            F.slice(target, n + 1, F.size(target)),
        ), "/"))

    return let(F.struct(
        _fold(base, base.startswith("/")).alias("source"),
        _fold(path, path.startswith("/")).alias("target"),
    ), lead)


def language(path_extension: Column) -> Column:
    """Language group of an extension, NULL when unknown."""
    pairs = [F.lit(x) for item in V.LANGUAGE_OF_EXTENSION.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), path_extension)

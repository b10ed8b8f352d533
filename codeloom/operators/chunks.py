"""Chunks of text: lines, fixed windows, code-aware pieces, and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.paths import extension, language
from codeloom.functions.text import let, non_empty_lines
from codeloom.operators.search import fuzzy_search


def fixed_windows(
    text: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP
) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = size - overlap
    last = F.floor(F.greatest(F.length(text) - overlap - 1, F.lit(0)) / step).cast("int")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(text, i * step + 1, F.lit(size)),
        )
    )


def _boundary_pattern(lang: Column) -> Column:
    """Pattern that matches in front of each boundary of the language, NULL if unknown."""
    pairs: list[Column] = []
    for name, boundaries in V.CODE_BOUNDARIES.items():
        quoted = "|".join("\\Q" + b + "\\E" for b in boundaries)
        pairs += [F.lit(name), F.lit(f"(?={quoted})")]
    return F.try_element_at(F.create_map(*pairs), lang)


def _refine(pieces: Column, pattern: str, size: int) -> Column:
    """Split the pieces that are longer than ``size`` in front of each match."""
    return F.flatten(F.transform(
        pieces,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
            F.filter(F.split(p, pattern), lambda x: x != "")
        ),
    ))


def _pieces(content: Column, lang: Column, size: int, cell: int) -> Column:
    """Gapless pieces of at most ``size`` characters: cut before language boundaries, and
    where that is not enough before empty lines, then newlines, then into cells of up to
    ``cell`` characters that end before a blank if there is one."""
    pieces = F.when(F.length(content) <= size, F.array(content)).otherwise(
        F.filter(F.split(content, _boundary_pattern(lang)), lambda x: x != "")
    )
    for finer in (r"(?=\n\n)", r"(?=\n)"):
        pieces = _refine(pieces, finer, size)
    cells = F.lit(rf"(?s).{{1,{cell}}}(?= |\z)|.{{1,{cell}}}")
    return F.flatten(F.transform(
        pieces,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
            F.regexp_extract_all(p, cells, F.lit(0))
        ),
    ))


def _pack(pieces: Column, size: int, overlap: int) -> Column:
    """Fill chunks with pieces in order; a chunk starts with the last whole pieces of the
    one before, as long as these stay within ``overlap`` and leave room for the next."""

    def state(open_, chars, shared, done) -> Column:
        return F.struct(
            open_.alias("open"), chars.alias("chars"), shared.alias("shared"),
            done.alias("done"),
        )

    def closed(s: Column) -> Column:
        return F.array_append(s["done"], F.struct(
            F.array_join(s["open"], "").alias("chunk"), s["shared"].alias("overlap")
        ))

    def tail(s: Column, room: Column) -> Column:
        start = F.struct(
            F.array().cast("array<string>").alias("kept"), F.lit(0).alias("chars"),
            F.lit(True).alias("more"),
        )

        def take(t: Column, piece: Column) -> Column:
            fits = t["more"] & (t["chars"] + F.length(piece) <= room)
            return F.when(fits, F.struct(
                F.array_prepend(t["kept"], piece).alias("kept"),
                (t["chars"] + F.length(piece)).alias("chars"),
                F.lit(True).alias("more"),
            )).otherwise(F.struct(
                t["kept"].alias("kept"), t["chars"].alias("chars"), F.lit(False).alias("more")
            ))

        return F.aggregate(F.reverse(s["open"]), start, take)

    def start_next(s: Column, piece: Column) -> Column:
        kept = tail(s, F.least(F.lit(overlap), F.lit(size) - F.length(piece)))
        return let(kept, lambda t: state(
            F.array_append(t["kept"], piece), t["chars"] + F.length(piece), t["chars"], closed(s)
        ))

    return F.aggregate(
        pieces,
        state(F.array().cast("array<string>"), F.lit(0), F.lit(0),
              F.array().cast("array<struct<chunk:string,overlap:int>>")),
        lambda s, p: F.when(
            s["chars"] + F.length(p) <= size,
            state(F.array_append(s["open"], p), s["chars"] + F.length(p), s["shared"], s["done"]),
        ).otherwise(start_next(s, p)),
        lambda s: F.when(F.size(s["open"]) > 0, closed(s)).otherwise(s["done"]),
    )


def code_pieces(
    content: Column, lang: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP
) -> Column:
    """Array of (chunk, overlap), NULL for an unknown language; ``overlap`` counts the
    characters that a chunk repeats from the one before, so chunks without them give the
    content back."""
    packed = _pack(_pieces(content, lang, size, overlap), size, overlap)
    return F.when(lang.isNotNull() & (F.length(content) > 0), packed).when(
        lang.isNotNull(), F.array().cast("array<struct<chunk:string,overlap:int>>")
    )


def chunk_array(
    path: Column, content: Column, split: str, size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
) -> Column:
    """Chunks of a file: ``none`` (the whole file), ``lines`` or ``code``. Files of an
    unknown language are split by line in code mode too."""
    if split == "none":
        return F.array(content)
    if split == "lines":
        return non_empty_lines(content)
    if split != "code":
        raise ValueError("split must be 'none', 'lines' or 'code'")
    lang = language(F.lower(extension(path)))
    chunks = F.transform(code_pieces(content, lang, size, overlap), lambda c: c["chunk"])
    return F.coalesce(chunks, non_empty_lines(content))


def chunk_files(files: DataFrame, split: str = "lines") -> DataFrame:
    """(path, chunk_index, chunk), one row per chunk."""
    return files.select(
        "path",
        F.posexplode(chunk_array(F.col("path"), F.col("content"), split))
        .alias("chunk_index", "chunk"),
    )


def fetch_chunks(requests: DataFrame, files: DataFrame, split: str = "lines") -> DataFrame:
    """The requested chunks (path, chunk_index); out of range gives ``''``.

    The chunk is picked inside the row of its file, so only requested files are split and no
    chunk table is shuffled.
    """
    asked = files.select("path", "content").join(
        requests.select("path").distinct(), "path", "left_semi"
    )
    found = requests.join(asked, "path", "left")
    chunks = chunk_array(F.col("path"), F.col("content"), split)
    return found.withColumn(
        "chunk", F.coalesce(F.get(chunks, F.col("chunk_index")), F.lit(""))
    ).drop("content")


def search_chunks(
    files: DataFrame, query: str, top_n: int = V.DEFAULT_TOP_N, split: str = "lines"
) -> DataFrame:
    """(rank, path, chunk_index, chunk) of the best files by name, in rank order."""
    # ``top_n`` rows at most, so the ranking needs no parallelism
    hits = fuzzy_search(files.select("path"), query, top_n)
    ranked = hits.selectExpr("path", "row_number() OVER (ORDER BY score, path) AS rank")
    chosen = files.join(F.broadcast(ranked), "path")
    chunks = chunk_array(F.col("path"), F.col("content"), split)
    return chosen.select(
        "rank", "path", F.posexplode(chunks).alias("chunk_index", "chunk")
    ).orderBy("rank", "chunk_index")

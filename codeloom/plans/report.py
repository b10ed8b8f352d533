"""Report tables: overview, chain map, file summaries, missing files, summary sheet.

A report is a table of text lines with an order key (section, seq, kind, pos); the text is
the lines in that order. Only a file's own links and a bounded part of its users are ever
gathered into one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.paths import stem
from codeloom.functions.text import strip
from codeloom.operators.graph import first_and_further, links_per_file

LINE_COLUMNS = ["seq", "kind", "pos", "line"]


def _bold(path: Column) -> Column:
    return F.concat(F.lit("- **"), path, F.lit("**"))


def _context(order: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    reached = edges.join(order.select(F.col("path").alias("src")), "src", "left_semi")
    return order.select("path", "seq").join(links_per_file(reached), "path", "left").withColumn(
        "links", F.coalesce("links", none)
    )


def _line(kind: int, pos: Column, line: Column) -> list[Column]:
    return [F.col("seq"), F.lit(kind).cast("long").alias("kind"),
            pos.cast("long").alias("pos"), line.alias("line")]


def overview_lines(order: DataFrame, edges: DataFrame, users: DataFrame) -> DataFrame:
    """One line per file with its links and users; further lines for the users of a file
    that is used from everywhere."""
    first, further = first_and_further(users)
    rows = _context(order, edges).join(first.select("path", "used_by"), "path", "left")
    links = F.when(
        F.size("links") > 0,
        F.concat(F.lit(" imports/links to: "), F.array_join("links", ", ")),
    ).otherwise("")
    used = F.coalesce(F.concat(F.lit(" | used by: "), "used_by"), F.lit(""))
    lines = rows.select(*_line(0, F.lit(0), F.concat(_bold(F.col("path")), links, used)))
    more = order.join(further, "path").select(
        *_line(0, F.col("part"), F.concat(F.lit("  | used by: "), "used_by"))
    )
    return lines.unionByName(more)


def chain_lines(order: DataFrame, edges: DataFrame, users: DataFrame) -> DataFrame:
    """A line per file, then one per link, then its users."""
    heads = order.select(*_line(0, F.lit(0), _bold(F.col("path"))))
    links = order.join(edges.select(F.col("src").alias("path"), "pos", "dst"), "path").select(
        *_line(1, F.col("pos"), F.concat(F.lit("  - links to: "), "dst"))
    )
    used = order.join(users, "path").select(
        *_line(2, F.col("part"), F.concat(F.lit("  - used by: "), "used_by"))
    )
    return heads.unionByName(links).unionByName(used)


def summary_lines(
    order: DataFrame, edges: DataFrame, users: DataFrame, summaries: DataFrame
) -> DataFrame:
    """Per file: heading and links, users, summary. Lines may hold line breaks."""
    shown = F.when(F.size("links") > 0, F.array_join("links", ", ")).otherwise(V.EMPTY_LIST)
    heads = _context(order, edges).select(*_line(0, F.lit(0), F.concat(
        F.lit("## "), "path", F.lit("\n\n**Links to:** "), shown, F.lit("\n"))))
    used = order.join(users, "path").select(*_line(1, F.col("part"), F.concat(
        F.lit("**Used by:** "), "used_by", F.lit("\n"))))
    texts = order.join(summaries.select("path", "summary"), "path", "left").select(
        *_line(2, F.lit(0), F.concat(
            F.lit("**Summary:**\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))))
    return heads.unionByName(used).unionByName(texts)


def missing_lines(missing: DataFrame) -> DataFrame:
    """(missing, line) of targets that are no file."""
    return missing.select("missing", F.concat(
        _bold(F.col("missing")), F.lit("\n  - Source: "), "source",
        F.lit("\n  - Reason wanted for review: "), "reason",
    ).alias("line"))


def summary_sheet(order: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, path, entry) from records (path, title, explanation, use_case, abstraction,
    functions_used)."""
    bullets = F.array_join(F.transform("links", lambda l: F.concat(F.lit("- "), l)), "\n")
    imports = F.when(F.size("links") > 0, bullets).otherwise(V.EMPTY_LIST)

    def part(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{title}:**\n"), value, F.lit("\n\n"))

    return _context(order, edges).join(records, "path").select(
        "seq", "path",
        F.concat(
            F.lit("## "), "title", F.lit(" ("), stem(F.col("path")), F.lit(".md)\n\n"),
            part("Explanation", F.col("explanation")),
            part("Use Case", F.col("use_case")),
            part("Abstraction/Responsibility", F.col("abstraction")),
            part("Functions/Abstractions Used", F.col("functions_used")),
            F.lit("**Imports:**\n"), imports, F.lit("\n\n"),
        ).alias("entry"),
    )


def files_summary(order: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """All lines of the files summary (section, seq, kind, pos, line)."""
    zero = F.lit(0).cast("long")
    sheet = summary_sheet(order, records, edges).select(
        F.lit(1).cast("long").alias("section"), "seq", zero.alias("kind"), zero.alias("pos"),
        # an entry ends in an empty line, the sink ends its row with a newline of its own
        F.regexp_replace("entry", r"\n\z", "").alias("line"))
    heading = order.sparkSession.range(1).select(
        zero.alias("section"), F.lit(-1).cast("long").alias("seq"), zero.alias("kind"),
        zero.alias("pos"), F.lit(f"{V.SUMMARIES_HEADING}\n").alias("line"))
    return heading.unionByName(sheet)


def review_lines(sections: DataFrame, history: DataFrame) -> DataFrame:
    """All lines of a review (section, key, at, line) in the order of these columns: bodies of
    ``sections`` (section_key, body) by key, then the tail with the entries of ``history``
    (updated_at, entry) by time.

    Nothing is gathered into one row: the text is the lines in order, so a review or a
    history of any length stays spread over tasks.
    """
    none, start = F.lit("").alias("key"), F.lit(None).cast("timestamp").alias("at")
    number = lambda n: F.lit(n).cast("long").alias("section")
    bodies = sections.select(
        number(0), F.col("section_key").alias("key"), start,
        F.concat(strip(F.col("body")), F.lit("\n")).alias("line"))
    heading = sections.sparkSession.range(1).select(
        number(1), none, start, F.lit(V.HISTORY_HEADING).alias("line"))
    entries = history.select(
        number(2), none, F.col("updated_at").alias("at"), F.col("entry").alias("line"))
    return bodies.unionByName(heading).unionByName(entries)


def _headings(spark: SparkSession, entry: str) -> DataFrame:
    """Fixed lines around the sections; their number does not depend on the data."""
    rows = [
        (0, 0, f"{V.OVERVIEW_HEADING}\n\n{V.OVERVIEW_INTRO}\n"),
        (1, 0, f"\n{V.OVERVIEW_CLOSING}{entry}**."),
        (1, 1, f"{V.CHAIN_HEADING}\n"),
        (3, 0, f"\n{V.SUMMARIES_HEADING}\n"),
    ]
    return spark.createDataFrame(rows, "section long, pos long, line string").select(
        "section", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("kind"),
        "pos", "line",
    )


def path_summary(
    order: DataFrame, edges: DataFrame, users: DataFrame, summaries: DataFrame,
    missing: DataFrame, entry: str,
) -> DataFrame:
    """All lines of the path summary (section, seq, kind, pos, line)."""
    def section(number: int, lines: DataFrame) -> DataFrame:
        return lines.select(F.lit(number).cast("long").alias("section"), *LINE_COLUMNS)

    lost = missing_lines(missing).select(
        F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("kind"),
        F.lit(0).cast("long").alias("pos"), "line")
    heading = missing.limit(1).select(
        F.lit(5).cast("long").alias("section"), F.lit(-1).cast("long").alias("seq"),
        F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("pos"),
        F.lit(f"\n{V.MISSING_HEADING}\n").alias("line"))
    return (
        _headings(order.sparkSession, entry)
        .unionByName(section(0, overview_lines(order, edges, users)))
        .unionByName(section(2, chain_lines(order, edges, users)))
        .unionByName(section(4, summary_lines(order, edges, users, summaries)))
        .unionByName(heading)
        .unionByName(section(5, lost))
    )

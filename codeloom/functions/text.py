"""Scalar text functions: titles, sections, history, links, run ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import fixed_values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas, where Spark would
    evaluate it again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)


def clean_title(value: Column) -> Column:
    text = strip(F.replace(value, F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(V.DEFAULT_TITLE))


def is_local_specifier(specifier: Column) -> Column:
    """Relative, absolute or drive path, i.e. not a library name."""
    return specifier.rlike(V.LOCAL_SPECIFIER)


def annotate_links(specifiers: Column) -> Column:
    return F.transform(
        specifiers,
        lambda s: F.when(is_local_specifier(s), s).otherwise(F.concat(s, F.lit(V.LIBRARY_SUFFIX))),
    )


def numbered_sections(text: Column) -> dict[str, Column]:
    """The four numbered parts of an answer; a part that is not found is ``''``."""
    parts = {
        name: strip(F.regexp_extract(text, pattern, 1))
        for name, pattern in V.SECTION_PATTERNS.items()
    }
    partial = F.lit(False)
    for part in parts.values():
        partial = partial | (part == "")
    return {**parts, "partial": partial}


def review_body(review: Column) -> Column:
    return strip(F.regexp_replace(review, V.HISTORY_TAIL, ""))


def review_history(review: Column) -> Column:
    """The history tail, or an empty history section."""
    found = strip(F.regexp_extract(review, f"({V.HISTORY_TAIL})", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(V.HISTORY_HEADING))


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")


def history_entry(ts: Column, reason: Column) -> Column:
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("- "), stamp, F.lit(": "), reason)


def join_text_parts(parts: Column) -> Column:
    """Text of a many-part message: its string parts, joined by a blank."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")


def provenance_prefix(answer: Column, used_full: Column, search: Column) -> Column:
    """Answer with a line per source that was used besides the summary."""
    with_full = F.when(used_full, F.concat(F.lit(V.FULL_FILE_PREFIX), answer)).otherwise(answer)
    return F.when(
        search.isNotNull(),
        F.concat(F.lit(V.SEARCH_PREFIX), F.to_json(search), F.lit("]\n"), with_full),
    ).otherwise(with_full)


def non_empty_lines(content: Column) -> Column:
    """Lines without the empty ones; lines of blanks stay."""
    return F.filter(F.split(content, r"\r?\n"), lambda line: line != "")


def needs_full_content(answer: Column, input_chars: Column) -> Column:
    """The answer says that it lacks context, or there was hardly any text to go by."""
    return answer.rlike(V.INSUFFICIENT_ANSWER) | (input_chars < V.SHORT_CONTENT)


def file_entry(path: Column, content: Column) -> Column:
    """A file inside a bundle: its name line, then its content."""
    return F.concat(F.lit("--- FILE: "), path, F.lit(" ---\n"), content, F.lit("\n"))

"""Path, text and filter functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions import filters, paths, text
from codeloom.operators import search
from codeloom.plans import corpora
from codeloom.plans.catalog.expected import quote
from codeloom.plans.corpora import table

_INCLUDE = {"regexp": r"^/corpus/SRC1\d/", "flags": "gi"}
_EXCLUDE = {"regexp": r"/(fr|de)/d\d*[05]\.txt$"}
_PATTERNS = {
    "mail": (r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]+", "i"),
    "license": (r"licen[sc]e|copyright", "i"),
    "number": (r"\d{3,}", None),
    "line_start": (r"^the ", "im"),
}


def _document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.document_files(spark, sf_dir).select("path")


def p1_substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _document_paths(spark, sf_dir)
    return docs.filter(filters.path_kept(F.col("path"), "src1", "/fr/"))


def p2_regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _document_paths(spark, sf_dir)
    return docs.filter(filters.path_kept(F.col("path"), _INCLUDE, _EXCLUDE, "/corpus"))


def p3_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _path_samples(spark, sf_dir)
    return every.filter(filters.has_extension(F.col("path"), [".ts", ".GZ"], True))


def p4_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex_search_all(corpora.document_files(spark, sf_dir), _PATTERNS)


def p4_regex_search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex_search(
        corpora.java_classes(spark, sf_dir), r"size = \d*5;", extensions=[".java"])


def p5_needs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    answer = F.when(F.col("quality") == 0, F.concat(F.lit("CANNOT answer: "), "text")).otherwise(
        F.col("text"))
    return answers.select(
        "doc_id", text.needs_full_content(answer, F.col("n_chars")).alias("needs_full"))


def p7_non_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.non_empty_lines(F.concat(F.lit("\r\n\n \n"), "text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("n"),
        F.md5(F.array_join(lines, "|")).alias("lines_md5"))


def _path_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    forms = [
        F.concat(F.lit("src/p"), key, F.lit(".d.ts")),
        F.concat(F.lit(".hidden"), key),
        F.concat(F.lit("a.b/Make"), key),
        F.concat(F.lit("x/..foo"), key),
        F.concat(F.lit("dir"), key, F.lit("/name.tar.GZ")),
        F.concat(F.lit("n"), key, F.lit(".")),
        F.concat(F.lit("up/to"), key, F.lit("/..")),
    ]
    return table(spark, sf_dir, "part").select(F.explode(F.array(*forms)).alias("path"))


def x1_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_samples(spark, sf_dir).select(
        "path", paths.extension(F.col("path")).alias("extension"))


def x2_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_samples(spark, sf_dir).select(
        "path", paths.stem(F.col("path")).alias("stem"))


def x3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def with_id(prefix: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), "page_id", F.lit(suffix))

    return table(spark, sf_dir, "pages").select(
        "page_id",
        paths.join_paths(with_id("a", "/b"), F.lit("../c/./d")).alias("joined"),
        paths.join_paths(F.lit("a"), with_id("../../x")).alias("above"),
        paths.join_paths(F.lit("/r"), with_id("../../x", "/")).alias("absolute"),
        paths.join_paths(F.lit(""), with_id("./p", "/..")).alias("empty"),
        paths.relative_path(with_id("/b/a"), with_id("/b/c/d")).alias("relative"),
        paths.normalize_path(
            F.concat(F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("//../q/.."))
        ).alias("folder"),
    )


def x4_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.slugify(F.col("text")).alias("slug"))


def x5_clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("role") == "user", F.concat(F.lit(" \n"), "text", F.lit("\t\n"))).otherwise(
        F.lit("\n \n"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.clean_title(raw).alias("title"))


_EXTENSIONS = [*V.LANGUAGE_OF_EXTENSION, ".txt", ""]


def x6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.lit(e) for e in _EXTENSIONS])
    ext = F.get(known, (F.col("p_partkey") % len(_EXTENSIONS)).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", paths.language(ext).alias("language"))


def x8_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.numbered_sections(F.col("text"))
    return corpora.numbered_answers(spark, sf_dir).select(
        "conv_id", "turn", *[c.alias(n) for n, c in parts.items()])


def x9_history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    review = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(
        "text", F.lit("\n\n## History\n\n- "), "doc_id", F.lit(": "), "source", F.lit("\n")))
    return docs.select(
        "doc_id", F.md5(text.review_body(review)).alias("body_md5"),
        text.review_history(review).alias("history"))


def x10_run_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.run_id(F.col("ts")).alias("run_id"))


def x11_history_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", text.history_entry(F.col("ts"), F.col("event_type")).alias("entry"))


def x12_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.col("role"), F.when(F.col("turn") % 2 == 0, F.col("text")), F.lit("end"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.join_text_parts(parts).alias("joined"))


def x13_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = F.when(F.col("lang") == "en", F.struct(
        F.col("source").alias("regex"), F.array(F.lit(".ts")).alias("fileTypes")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.provenance_prefix(F.col("text"), F.col("doc_id") % 2 == 0, searched).alias("answer"))


QUERIES = {f.__name__: f for f in (
    p1_substring_filter, p2_regex_filter, p3_extension_filter, p4_regex_search,
    p4_regex_search_files, p5_needs_full, p7_non_empty_lines, x1_extension, x2_stem,
    x3_paths, x4_slugify, x5_clean_title, x6_language, x8_sections, x9_history_split,
    x10_run_id, x11_history_entry, x12_join_parts, x13_provenance,
)}

_DOC_PATHS = """
WITH d AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS path, text FROM documents)
"""
_SAMPLES = """
WITH s AS (SELECT unnest(['src/p' || p_partkey || '.d.ts', '.hidden' || p_partkey,
  'a.b/Make' || p_partkey, 'x/..foo' || p_partkey, 'dir' || p_partkey || '/name.tar.GZ',
  'n' || p_partkey || '.', 'up/to' || p_partkey || '/..']) AS path FROM part),
e AS (SELECT path, regexp_extract(path, '[^/]*$') AS base,
  CASE WHEN path LIKE '%/..' THEN '' ELSE
    regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1) END AS ext FROM s)
"""

ORACLES = {
    "p1_substring_filter": _DOC_PATHS + """
SELECT path FROM d WHERE path LIKE '%src1%' AND path NOT LIKE '%/fr/%'""",
    "p2_regex_filter": _DOC_PATHS + """
SELECT path FROM d WHERE regexp_matches('/corpus/' || path, '^/corpus/src1[0-9]/')
AND NOT regexp_matches(path, '/(fr|de)/d[0-9]*[05]\\.txt$')""",
    "p3_extension_filter": _SAMPLES + "SELECT path FROM e WHERE ext IN ('.ts', '.GZ')",
    "p4_regex_search": _DOC_PATHS + "\nUNION ALL\n".join(
        f"SELECT path, '{name}' AS pattern FROM d WHERE regexp_matches(text,"
        f" {quote('(?' + (flags or 's') + ')' + regexp)})"
        for name, (regexp, flags) in _PATTERNS.items()),
    "p4_regex_search_files": """
SELECT 'java/P' || p_partkey || '.java' AS path FROM part WHERE p_size % 10 = 5""",
    "p5_needs_full": f"""
SELECT d.doc_id, coalesce(l.quality = 0, false) OR d.n_chars < 100
  OR regexp_matches(d.text, {quote(V.INSUFFICIENT_ANSWER)}) AS needs_full
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "p7_non_empty_lines": """
WITH l AS (SELECT doc_id, list_filter(string_split_regex(
  chr(13) || chr(10) || chr(10) || ' ' || chr(10) || text, '\\r?\\n'), lambda x: x <> '') AS lines
  FROM documents)
SELECT doc_id, len(lines) AS n, md5(array_to_string(lines, '|')) AS lines_md5 FROM l""",
    "x1_extension": _SAMPLES + "SELECT path, ext AS extension FROM e",
    "x2_stem": _SAMPLES + "SELECT path, left(base, length(base) - length(ext)) AS stem FROM e",
    "x3_paths": """
SELECT page_id, 'a' || page_id || '/c/d' AS joined, '../x' || page_id AS above,
  '/x' || page_id || '/' AS absolute, '.' AS empty, '../c/d' || page_id AS relative,
  CASE WHEN rtrim(regexp_extract(url, '^https?://(.*)$', 1), '/') LIKE '%/%'
    THEN regexp_extract(rtrim(regexp_extract(url, '^https?://(.*)$', 1), '/'), '^(.*)/[^/]*$', 1)
    ELSE '.' END AS folder
FROM pages""",
    "x4_slugify": """
SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g'), 60) AS slug FROM documents""",
    "x5_clean_title": """
SELECT conv_id, turn, CASE WHEN role = 'user' AND trim(text, chr(9) || chr(10) || ' ') <> ''
  THEN trim(replace(text, chr(10), ' '), chr(9) || ' ') ELSE 'Code File' END AS title
FROM conversations""",
    "x6_language": f"""
SELECT p_partkey, [{', '.join(
    quote(V.LANGUAGE_OF_EXTENSION[e]) if e in V.LANGUAGE_OF_EXTENSION else 'NULL'
    for e in _EXTENSIONS)}][p_partkey % {len(_EXTENSIONS)} + 1] AS language FROM part""",
    "x8_sections": """
WITH t AS (SELECT conv_id, turn, turn % 4 = 3 AS cut, role FROM conversations)
SELECT conv_id, turn, CASE WHEN role LIKE '%2.%' THEN '' ELSE 'by ' || role END AS explanation,
  'turn ' || turn AS use_case, CASE WHEN cut THEN '' ELSE 'talk ' || conv_id END AS abstraction,
  CASE WHEN cut THEN '' ELSE 'f' || conv_id END AS functions_used, cut AS partial
FROM t""",
    "x9_history_split": """
SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body_md5,
  CASE WHEN lang = 'en' THEN '## History' || chr(10)
  ELSE '## History' || chr(10) || chr(10) || '- ' || doc_id || ': ' || source END AS history
FROM documents""",
    "x10_run_id": "SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS run_id FROM events",
    "x11_history_entry": """
SELECT event_id, '- ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z: ' || event_type AS entry
FROM events""",
    "x12_join_parts": """
SELECT conv_id, turn, role || CASE WHEN turn % 2 = 0 THEN ' ' || text ELSE '' END || ' end'
  AS joined FROM conversations""",
    "x13_provenance": """
SELECT doc_id, CASE WHEN lang = 'en' THEN '[Structured regex search used: {"regex":"' || source
    || '","fileTypes":[".ts"]}]' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN '[Full file used for context]' || chr(10) ELSE '' END
  || text AS answer FROM documents""",
}

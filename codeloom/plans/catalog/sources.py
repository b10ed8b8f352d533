"""Listing, reading and writing of files, notes, reports and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import chunks, graph, links
from codeloom.plans import corpora, report
from codeloom.plans.catalog import expected as X
from codeloom.plans.catalog import links as L
from codeloom.plans.catalog.links import reached_context, records
from codeloom.plans.corpora import table
from codeloom.session import cut_lineage, scratch_path
from codeloom.sources import files as S
from codeloom.sources import sinks as K
from codeloom.sources import tree
from codeloom.streaming.reviews import as_updates

_FOLDER_FILE = r"file=([^/]+)/"
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of nulls


def _written_js_modules(spark: SparkSession, sf_dir: str) -> str:
    """The JS corpus as real files, one folder per file name."""
    target = scratch_path(spark, "js-tree")
    # the text sink ends every row with a newline of its own
    rows = corpora.js_modules(spark, sf_dir).select(
        F.regexp_replace("path", "^js/", "").alias("file"),
        F.regexp_replace("content", r"\n\z", "").alias("value"),
    )
    if S.on_mounted(spark, target):
        named = F.concat(F.lit("file="), F.coalesce("file", F.lit(_NO_NAME)))
        tree.write_folders(rows.select(named.alias("folder"), "value"), target)
    else:
        rows.repartition("file").write.partitionBy("file").text(target)
    return target


def s1_list_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = S.list_files(
        spark, _written_js_modules(spark, sf_dir), include="m",
        exclude={"regexp": r"/FILE=m\d*9\.JS/", "flags": "gi"},
    )
    return listed.select(F.regexp_extract("path", _FOLDER_FILE, 1).alias("file"), "size")


def s2_list_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.list_by_extension(corpora.ts_paths(spark, sf_dir), [".JS"])
    return found.select("path")


def s3_read_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = S.read_files(spark, _written_js_modules(spark, sf_dir), extensions=[".txt"])
    return read.select(
        F.regexp_extract("path", _FOLDER_FILE, 1).alias("file"), "size", "content"
    )


def s4_read_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.read_requested(corpora.requests(spark, sf_dir), corpora.ts_modules(spark, sf_dir))
    return got.select("position", "path", "error", F.md5("content").alias("content_md5"))


def s4_read_requested_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.read_requested(
        corpora.requests(spark, sf_dir), corpora.ts_modules(spark, sf_dir), missing="skip")
    return got.select("position", "path")


def s5_summarized_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = (
        corpora.ts_modules(spark, sf_dir)
        .unionByName(corpora.js_modules(spark, sf_dir))
        .unionByName(corpora.java_classes(spark, sf_dir))
        .unionByName(corpora.document_files(spark, sf_dir))
    )
    return S.read_summarized(everything).select("path", "content")


def s6_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("bundle_id"),
        F.col("turn").alias("position"),
        F.concat(F.lit("turn"), "turn", F.lit(".txt")).alias("path"),
        F.when(F.col("role") != "user", F.col("text")).alias("content"),
        F.lit("not found").alias("error"),
    )
    return S.render_bundle(turns, per_part=4)


def s7_fetch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.document_files(spark, sf_dir)
    wanted = docs.select("path").withColumn("chunk_index", (F.length("path") % 5).cast("int"))
    return chunks.fetch_chunks(wanted, docs, "lines")


def k1_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    ).select(
        F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"),
        F.when(F.col("quality") == 1, F.concat(F.lit("\n\t"), "text", F.lit("\t\n")))
        .when(F.col("quality") == 0, "\n \t\n").alias("body"),
    )
    target = scratch_path(spark, "notes")
    K.write_notes(rows, target, "2024-01-01-00")
    return K.read_notes(spark, target).select("run_id", "path", "note")


def k2_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges, users, _ = reached_context(spark, sf_dir)
    entry = order.filter("seq = 0").first()["path"]
    summary = report.path_summary(
        order, edges, users,
        order.select("path", F.concat(F.lit("about "), "path").alias("summary")),
        graph.missing_targets(
            edges.join(order.select(F.col("path").alias("src")), "src", "left_semi")),
        entry,
    )
    # the final review is the same text under a name of its own
    whole = cut_lineage(summary)
    lines = whole.withColumn("report", F.lit("path-summary")).unionByName(
        whole.withColumn("report", F.lit("review"))
    ).unionByName(report.files_summary(order, records(order), edges).withColumn(
        "report", F.lit("files-summary")))
    target = scratch_path(spark, "reports")
    K.write_report(lines, target, "2024-01-01-00")
    return spark.read.schema("line string, run_id string, report string").text(target).select(
        "run_id", "report", F.col("line")
    )


def k3_review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = as_updates(table(spark, sf_dir, "events"))
    target = scratch_path(spark, "review")
    early = F.col("updated_at") < "2024-02-01"
    K.write_review(spark, target, None, "1", updates.filter(early))
    final = K.write_review(spark, target, "1", "2", updates.filter(~early))
    history = spark.read.schema(
        "updated_at timestamp, entry string, version string").parquet(f"{target}/history")
    return final.select(
        F.lit("section").alias("kind"), F.col("section_key").alias("key"), "body"
    ).unionByName(history.select(
        F.lit("history").alias("kind"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("key"),
        F.col("entry").alias("body"),
    ))


def k3_rendered_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the review: every line with the part of the text that it stands in."""
    target = scratch_path(spark, "review")
    final = K.write_review(spark, target, None, "1", as_updates(table(spark, sf_dir, "events")))
    history = spark.read.schema(
        "updated_at timestamp, entry string, version string").parquet(f"{target}/history")
    K.write_rendered_review(report.review_lines(final, history), target, "1")
    return spark.read.schema("line string, version string").text(f"{target}/text").select(
        "version", "line")


QUERIES = {f.__name__: f for f in (
    s1_list_corpus, s2_list_by_extension, s3_read_full, s4_read_requested,
    s4_read_requested_skip, s5_summarized_read, s6_bundle, s7_fetch_chunks, k1_notes,
    k2_reports, k3_review_upsert, k3_rendered_review,
)}

_SUMMARIES = f"""{X.LINKS}
SELECT 'src/orders/o' || o_orderkey || '.ts' AS path,
  'import fs from "fs";' || coalesce((SELECT string_agg(chr(10) || 'import {{ p' || p
    || ' }} from "../parts/p' || p || '";', '' ORDER BY p) FROM op WHERE o = o_orderkey), '')
  || chr(10) || chr(10) || 'type Due' || o_orderkey || ' = Date;'
  || chr(10) || chr(10) || 'interface Basket' || o_orderkey || ' {{' || chr(10)
  || '  lines: string[];'
  || chr(10) || chr(10) || 'interface Sealed' || o_orderkey || ' {{' || chr(10) || '}}'
  || chr(10) || chr(10) || 'export function tax' || o_orderkey || '(net: number): number {{'
  AS content FROM orders
UNION ALL
SELECT 'src/parts/p' || p_partkey || '.ts',
  coalesce((SELECT string_agg('import {{ s' || s || ' }} from "../supp/s' || s || '.js";',
    chr(10) ORDER BY s) FROM ps WHERE p = p_partkey) || chr(10) || chr(10), '')
  || 'export type Size' || p_partkey || ' = ' || p_size || ';' FROM part
UNION ALL
SELECT 'src/supp/s' || s_suppkey || '.js',
  'import nation from "./nation' || s_nationkey || '";'
  || coalesce((SELECT chr(10) || 'import back from "../parts/p' || p || '";' FROM sp
               WHERE s = s_suppkey), '')
  || chr(10) || chr(10) || 'export const name' || s_suppkey || ' = "' || s_name || '";'
FROM supplier
UNION ALL
SELECT 'js/m' || s_suppkey || '.js', array_to_string([
  'import {{ stat }} from ''node:fs'';',
  'const tally = require(''./tally-' || s_suppkey || ''');',
  '/* Depot ' || s_suppkey || ': ' || s_name || chr(10) || '   opened once */' || chr(10)
    || '//depot/' || s_suppkey || '";' || chr(10) || '// closing time of ' || s_suppkey,
  'export function weigh' || s_suppkey || '(crate, tare);',
  'export let label' || s_suppkey || ' = "' || s_name || '";' || chr(10)
    || 'export var site' || s_suppkey || ' = "ftp://depot/' || s_suppkey || '";',
  'export weigh' || s_suppkey || ';', 'export heavy' || s_suppkey || ';',
  'export limit' || s_suppkey || ';', 'export depth' || s_suppkey || ';',
  'export close' || s_suppkey || ';'], chr(10) || chr(10)) FROM supplier
UNION ALL
SELECT 'java/P' || p_partkey || '.java', array_to_string([
  'import freight.kind.' || p_type || ';' || chr(10) || 'import java.time.Instant;',
  'interface Tariff' || p_partkey || ' {{ {{', '}}',
  '@Tracked' || chr(10) || '@Label("' || p_name || '")',
  'public class Crate' || p_partkey || ' {{ {{', '}}',
  '    Money quote' || p_partkey || '(Route route);',
  '    @Audited', '    public void ship' || p_partkey || '(' || chr(10)
    || '        Route route,' || chr(10) || '        Instant start' || chr(10) || '    ) ;',
  '    @Cached(minutes = 5)', '    public long volume' || p_partkey || '() ;',
  '    public Crate' || p_partkey || '(Route home) ;'], chr(10) || chr(10)) FROM part
UNION ALL
SELECT source || '/' || lang || '/d' || doc_id || '.txt', text FROM documents"""

_REPORT = X.CONTEXT.rstrip() + """,
heads AS (
  SELECT r.path, r.seq, l.links, u.used_by FROM reach r
  LEFT JOIN file_links l USING (path) LEFT JOIN users u ON u.path = r.path AND u.is_first),
lost AS (
  SELECT e.dst, min(e.src) AS source, arg_min(e.spec, (e.src, e.pos)) AS spec
  FROM edges e JOIN reach r ON r.path = e.src
  WHERE e.dst NOT IN (SELECT path FROM files) GROUP BY 1),
texts AS (
  SELECT '# General Overview' || chr(10) || chr(10) || 'This codebase consists of the following'
    || ' researched files and their relationships:' || chr(10) AS t
  UNION ALL
  SELECT '- **' || path || '**' || coalesce(' imports/links to: ' || links, '')
    || coalesce(' | used by: ' || used_by, '') FROM heads
  UNION ALL
  SELECT '  | used by: ' || used_by FROM users WHERE NOT is_first AND path IN (SELECT path FROM reach)
  UNION ALL
  SELECT chr(10) || 'The dependency graph shows how files are interconnected, with arrows'
    || ' indicating import or usage relationships. Entry file: **' || path || '**.'
  FROM reach WHERE seq = 0
  UNION ALL SELECT '# Code Chain Map' || chr(10)
  UNION ALL SELECT '- **' || path || '**' FROM reach
  UNION ALL SELECT '  - links to: ' || dst FROM edges WHERE src IN (SELECT path FROM reach)
  UNION ALL
  SELECT '  - used by: ' || used_by FROM users WHERE path IN (SELECT path FROM reach)
  UNION ALL SELECT chr(10) || '# File Summaries' || chr(10)
  UNION ALL
  SELECT '## ' || path || chr(10) || chr(10) || '**Links to:** ' || coalesce(links, '(none)')
    || chr(10) FROM heads
  UNION ALL
  SELECT '**Used by:** ' || used_by || chr(10) FROM users WHERE path IN (SELECT path FROM reach)
  UNION ALL
  SELECT '**Summary:**' || chr(10) || 'about ' || path || chr(10) FROM reach
  UNION ALL SELECT chr(10) || '# Missing Files' || chr(10) WHERE EXISTS (SELECT 1 FROM lost)
  UNION ALL
  SELECT '- **' || dst || '**' || chr(10) || '  - Source: ' || source || chr(10)
    || '  - Reason wanted for review: imported as ' || spec FROM lost),
sheet AS (
  SELECT '# File Summaries' || chr(10) AS t
  UNION ALL
  SELECT regexp_replace(entry, '\\n$', '') FROM (""" + L.SHEET + """)),
written AS (
  SELECT unnest(['path-summary', 'review']) AS report, t FROM texts
  UNION ALL SELECT 'files-summary', t FROM sheet)
SELECT '2024-01-01-00' AS run_id, report,
       unnest(string_split(t, chr(10))) AS line FROM written"""

ORACLES = {
    "s1_list_corpus": f"""
SELECT 'm' || s_suppkey || '.js' AS file, strlen({X.JS_TEXT})::BIGINT AS size FROM supplier
WHERE s_suppkey % 10 <> 9""",
    "s2_list_by_extension": "SELECT 'src/supp/s' || s_suppkey || '.js' AS path FROM supplier",
    "s3_read_full": f"""
SELECT 'm' || s_suppkey || '.js' AS file, strlen({X.JS_TEXT})::BIGINT AS size,
       {X.JS_TEXT} AS content FROM supplier""",
    "s4_read_requested": f"""{X.LINKS}
SELECT o_orderkey AS position,
  'src/orders/o' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '.old' ELSE '.ts' END AS path,
  CASE WHEN o_orderkey % 10 = 0 THEN 'not found' END AS error,
  CASE WHEN o_orderkey % 10 <> 0 THEN md5({X.ORDER_TEXT}) END AS content_md5
FROM orders""",
    "s4_read_requested_skip": """
SELECT o_orderkey AS position, 'src/orders/o' || o_orderkey || '.ts' AS path
FROM orders WHERE o_orderkey % 10 <> 0""",
    "s5_summarized_read": _SUMMARIES,
    "s6_bundle": """
SELECT conv_id AS bundle_id, turn // 4 AS part,
  string_agg('--- FILE: turn' || turn || '.txt ---' || chr(10)
    || CASE WHEN role <> 'user' THEN text ELSE 'Error: not found' END || chr(10),
    chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY 1, 2""",
    "s7_fetch_chunks": """
WITH d AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS path, text FROM documents)
SELECT path, (length(path) % 5)::INTEGER AS chunk_index,
  coalesce(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: x <> '')
    [length(path) % 5 + 1], '') AS chunk
FROM d""",
    "k1_notes": r"""
SELECT '2024-01-01-00' AS run_id, 'd' || d.doc_id || '.txt' AS path,
  CASE WHEN l.quality = 1 AND regexp_matches(d.text, '\S')
       THEN regexp_replace(d.text, '^\s+|\s+$', '', 'g') ELSE '# No explanation available.' END AS note
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "k2_reports": _REPORT,
    "k3_rendered_review": """
WITH best AS (
  SELECT arg_max(props, (length(props), ts, props)) AS body FROM events GROUP BY user_id),
texts AS (
  SELECT trim(body, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS t FROM best
  UNION ALL SELECT '## History' || chr(10)
  UNION ALL
  SELECT '- ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z: ' || event_type FROM events)
SELECT '1' AS version, unnest(string_split(t, chr(10))) AS line FROM texts""",
    "k3_review_upsert": """
SELECT 'section' AS kind, user_id::VARCHAR AS key,
       arg_max(props, (length(props), ts, props)) AS body FROM events GROUP BY user_id
UNION ALL
SELECT 'history', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'),
  '- ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z: ' || event_type FROM events""",
}

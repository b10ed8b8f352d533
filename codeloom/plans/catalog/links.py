"""Import links, walks over the link graph, and the reports made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.text import annotate_links
from codeloom.operators import dedup, graph, links
from codeloom.plans import corpora, report
from codeloom.plans.catalog import expected as X
from codeloom.plans.corpora import table
from codeloom.session import cut_lineage, stored_by


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative links between the TS corpus' files, resolved."""
    return links.import_edges(
        corpora.ts_modules(spark, sf_dir), known=corpora.ts_paths(spark, sf_dir)
    ).filter("is_relative")


def entry_file(spark: SparkSession, sf_dir: str) -> str:
    key = table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey")).first()[0]
    return f"src/orders/o{key}.ts"


def reached(
    spark: SparkSession, sf_dir: str, chains: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Walk from the entry file: (reached files, all edges)."""
    edges = stored_by(_edges(spark, sf_dir).select(
        "src", F.col("pos").cast("long").alias("pos"), "spec", "dst", "is_relative",
        "resolved"), "src", "edges")
    order = graph.breadth_first(
        edges, [entry_file(spark, sf_dir)], chains=chains, by_source=True)
    return order, edges


def reached_context(spark: SparkSession, sf_dir: str):
    """(order, edges, users, files): what the reports are made from."""
    order, edges = reached(spark, sf_dir)
    users = cut_lineage(graph.used_by(edges, order, X.PER_ROW))
    files = corpora.ts_paths(spark, sf_dir)
    return order.select("path", "seq"), edges, users, files


def records(order: DataFrame) -> DataFrame:
    """Stand-in answers about each file, for the summary sheet."""
    return order.select(
        "path", F.lit(V.DEFAULT_TITLE).alias("title"),
        F.concat(F.lit("explains "), "path").alias("explanation"),
        F.lit("").alias("use_case"), F.lit("holds data").alias("abstraction"),
        F.lit("none").alias("functions_used"))


def g1_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(corpora.ts_modules(spark, sf_dir)).select(
        "src", F.col("pos").cast("long").alias("pos"), "spec")


def p6_relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(corpora.ts_modules(spark, sf_dir)).filter("is_relative").select(
        "src", "spec")


def g2_resolve_importer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.import_edges(
        corpora.ts_modules(spark, sf_dir), "importer", corpora.ts_paths(spark, sf_dir))
    return found.select("src", "spec", "dst", "resolved")


def g2_resolve_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.import_edges(
        corpora.ts_modules(spark, sf_dir), "root", corpora.ts_paths(spark, sf_dir))
    return found.filter("is_relative").select("src", "spec", "dst", "resolved")


def g3_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    forms = table(spark, sf_dir, "part").select(F.explode(F.array(
        F.concat(F.lit("./x"), key), F.concat(F.lit("../y/x"), key),
        F.concat(F.lit("/abs/"), key), F.concat(F.lit("C:\\w"), key),
        F.concat(F.lit("lib"), key), F.concat(F.lit("@scope/p"), key),
    )).alias("spec"))
    imported = links.extract_links(corpora.ts_modules(spark, sf_dir)).select("spec")
    every = forms.unionByName(imported).withColumns(links.classify(F.col("spec")))
    return every.groupBy("spec", "link_class").agg(F.count("*").alias("n"))


def g4_breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(spark, sf_dir)[0].select("path", "depth")


def g5_discovery_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(spark, sf_dir)[0].select("path", "parent", "seq")


def g6_chain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached(spark, sf_dir, chains=True)[0].select("path", "depth", "chain")


def g6_trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace_order(reached(spark, sf_dir)[0].select("path", "parent", "seq"))


def g7_reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_dependencies(_edges(spark, sf_dir))


def g8_missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.missing_targets(_edges(spark, sf_dir))


def g9_unexplored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(source: DataFrame, key: str, *aspects: str) -> DataFrame:
        return source.select(
            F.concat(F.lit("c"), key).alias("path"),
            F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))

    orders = table(spark, sf_dir, "orders")
    explored = work(orders, "o_custkey", "summary").unionByName(
        work(orders.filter("o_orderstatus = 'F'"), "o_custkey", "full"))
    return graph.unexplored(
        work(table(spark, sf_dir, "customer"), "c_custkey", "summary", "full"), explored)


def g11_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges = reached(spark, sf_dir)
    summaries = order.filter("depth > 0").select(
        "path", F.concat(F.lit("from "), "parent").alias("summary"))
    joined = graph.with_context(order.select("path"), edges, order, summaries, X.PER_ROW)
    return joined.select(
        "path", "part", F.array_join("links", ", ").alias("links"), "used_by", "summary")


def x7_annotate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = links.link_specifiers(F.col("content"))
    return corpora.ts_modules(spark, sf_dir).select(
        "path", F.array_join(annotate_links(specs), ", ").alias("links"))


def a1_links_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = graph.links_per_file(_edges(spark, sf_dir))
    return per_file.select("path", F.array_join("links", ", ").alias("links"))


def a2_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_context(spark, sf_dir)[2]


def a3_overview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges, users, _ = reached_context(spark, sf_dir)
    return report.overview_lines(order, edges, users)


def a4_chain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges, users, _ = reached_context(spark, sf_dir)
    return report.chain_lines(order, edges, users)


def a5_file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges, users, _ = reached_context(spark, sf_dir)
    summaries = order.select("path", F.concat(F.lit("about "), "path").alias("summary"))
    return report.summary_lines(order, edges, users, summaries)


def a5_summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, edges, _, _ = reached_context(spark, sf_dir)
    return report.summary_sheet(order, records(order), edges)


def a7_missing_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.missing_lines(graph.missing_targets(_edges(spark, sf_dir)))


def u1_union_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: its links, then the raw specifiers it names."""
    edges = stored_by(
        _edges(spark, sf_dir).select("src", "pos", "dst", "spec"), "src", "edges")
    named = graph.links_per_file(edges.select("src", "pos", F.col("spec").alias("dst")))
    found = graph.links_per_file(edges).join(
        named.withColumnRenamed("links", "specs"), "path")
    return found.select("path", F.array_join(
        dedup.union_needed(F.col("links"), F.col("specs")), ", ").alias("needed"))


def u2_next_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all files against files that the orders of a customer need."""
    linked = _edges(spark, sf_dir).select(
        F.col("dst").alias("path"), F.col("src").alias("parent"),
        F.col("pos").cast("long").alias("pos"))
    needed = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src/parts/p"), F.col("o_custkey"), F.lit(".ts")).alias("path"),
        F.concat(F.lit("src/orders/o"), "o_orderkey", F.lit(".ts")).alias("parent"),
        F.lit(0).cast("long").alias("pos"))
    return graph.next_frontier(linked, needed)


QUERIES = {f.__name__: f for f in (
    g1_link_edges, p6_relative_links, g2_resolve_importer, g2_resolve_root, g3_classify,
    g4_breadth_first, g5_discovery_parent, g6_chain_trace, g6_trace_order, g7_reverse_dependencies,
    g8_missing_targets, g9_unexplored, g11_context_join, x7_annotate_links,
    a1_links_per_file, a2_used_by, a3_overview_lines, a4_chain_map, a5_file_summaries,
    a5_summary_sheet, a7_missing_section, u1_union_needed, u2_next_frontier,
)}

_MISSING = """
SELECT dst, min(src) AS source, arg_min(spec, (src, pos)) AS spec, count(*) AS n
FROM edges WHERE dst NOT IN (SELECT path FROM files) GROUP BY 1"""

_HEADS = """heads AS (
  SELECT r.path, r.seq, l.links, u.used_by FROM reach r
  LEFT JOIN file_links l USING (path) LEFT JOIN users u ON u.path = r.path AND u.is_first)"""

SHEET = """
SELECT r.seq, r.path, '## Code File (' || regexp_extract(r.path, '([^/]*?)(\\.[jt]s)?$', 1)
  || '.md)' || chr(10) || chr(10)
  || '**Explanation:**' || chr(10) || 'explains ' || r.path || chr(10) || chr(10)
  || '**Use Case:**' || chr(10) || chr(10) || chr(10)
  || '**Abstraction/Responsibility:**' || chr(10) || 'holds data' || chr(10) || chr(10)
  || '**Functions/Abstractions Used:**' || chr(10) || 'none' || chr(10) || chr(10)
  || '**Imports:**' || chr(10) || coalesce('- ' || replace(l.links, ', ', chr(10) || '- '),
    '(none)') || chr(10) || chr(10) AS entry
FROM reach r LEFT JOIN file_links l USING (path)"""

ORACLES = {
    "g1_link_edges": X.LINKS + "SELECT src, pos::BIGINT AS pos, spec FROM links",
    "p6_relative_links": X.LINKS + "SELECT src, spec FROM links WHERE spec <> 'fs'",
    "g2_resolve_importer": X.LINKS + """
SELECT src, spec, dst, dst IN (SELECT path FROM files) AS resolved FROM links""",
    "g2_resolve_root": X.LINKS + """
SELECT src, spec, regexp_replace(spec, '^\\./', '') AS dst, false AS resolved FROM edges""",
    "g3_classify": X.LINKS + """,
specs AS (
  SELECT unnest(['./x' || p_partkey, '../y/x' || p_partkey, '/abs/' || p_partkey,
                 'C:\\w' || p_partkey, 'lib' || p_partkey, '@scope/p' || p_partkey]) AS spec
  FROM part
  UNION ALL SELECT spec FROM links)
SELECT spec,
  CASE WHEN left(spec, 1) = '.' THEN 'relative'
       WHEN left(spec, 1) = '/' OR left(spec, 3) = 'C:\\' THEN 'absolute'
       ELSE 'library' END AS link_class, count(*) AS n
FROM specs GROUP BY 1, 2""",
    "g4_breadth_first": X.REACH + "SELECT path, depth FROM reach",
    "g5_discovery_parent": X.REACH + "SELECT path, parent, seq FROM reach",
    "g6_chain_trace": X.REACH + "SELECT path, depth, chain FROM reach",
    "g6_trace_order": X.REACH.rstrip() + """,
ways AS (
  SELECT path, parent, seq, [seq] AS way FROM reach WHERE depth = 0
  UNION ALL
  SELECT r.path, r.parent, r.seq, list_append(w.way, r.seq)
  FROM ways w JOIN reach r ON r.parent = w.path),
sizes AS (SELECT s AS seq, count(*) AS n FROM (SELECT unnest(way) AS s FROM ways) GROUP BY 1)
SELECT w.path, w.parent, w.seq, row_number() OVER (ORDER BY w.way) - 1 AS preorder,
       z.n AS subtree
FROM ways w JOIN sizes z USING (seq)""",
    "g7_reverse_dependencies": X.LINKS + "SELECT DISTINCT dst, src FROM edges",
    "g8_missing_targets": X.LINKS + f"""
SELECT dst AS missing, source, 'imported as ' || spec AS reason, n AS n_links
FROM ({_MISSING})""",
    "g9_unexplored": """
WITH explored AS (
  SELECT 'c' || o_custkey AS path, 'summary' AS aspect FROM orders
  UNION SELECT 'c' || o_custkey, 'full' FROM orders WHERE o_orderstatus = 'F')
SELECT path, aspect FROM (
  SELECT 'c' || c_custkey AS path, unnest(['summary', 'full']) AS aspect FROM customer)
EXCEPT SELECT path, aspect FROM explored""",
    "g11_context_join": X.CONTEXT.rstrip() + f""",
{_HEADS}
SELECT h.path, 0::BIGINT AS part, h.links, h.used_by, 'from ' || r.parent AS summary
FROM heads h JOIN reach r USING (path)
UNION ALL
SELECT path, part, NULL, used_by, NULL FROM users
WHERE NOT is_first AND path IN (SELECT path FROM reach)""",
    "x7_annotate_links": X.LINKS + """
SELECT f.path, coalesce(string_agg(
  CASE WHEN l.spec = 'fs' THEN 'fs (library)' ELSE l.spec END, ', ' ORDER BY l.pos), '') AS links
FROM files f LEFT JOIN links l ON l.src = f.path GROUP BY 1""",
    "a1_links_per_file": X.LINKS + """
SELECT src AS path, string_agg(dst, ', ' ORDER BY pos) AS links FROM edges GROUP BY 1""",
    "a2_used_by": X.CONTEXT + "SELECT path, part, used_by FROM users",
    "a3_overview_lines": X.CONTEXT.rstrip() + f""",
{_HEADS}
SELECT seq, 0::BIGINT AS kind, 0::BIGINT AS pos,
  '- **' || path || '**' || coalesce(' imports/links to: ' || links, '')
  || coalesce(' | used by: ' || used_by, '') AS line FROM heads
UNION ALL
SELECT r.seq, 0, u.part, '  | used by: ' || u.used_by
FROM users u JOIN reach r USING (path) WHERE NOT u.is_first""",
    "a4_chain_map": X.CONTEXT + """
SELECT seq, 0::BIGINT AS kind, 0::BIGINT AS pos, '- **' || path || '**' AS line FROM reach
UNION ALL
SELECT r.seq, 1, e.pos, '  - links to: ' || e.dst FROM edges e JOIN reach r ON r.path = e.src
UNION ALL
SELECT r.seq, 2, u.part, '  - used by: ' || u.used_by FROM users u JOIN reach r USING (path)""",
    "a5_file_summaries": X.CONTEXT.rstrip() + f""",
{_HEADS}
SELECT seq, 0::BIGINT AS kind, 0::BIGINT AS pos, '## ' || path || chr(10) || chr(10)
  || '**Links to:** ' || coalesce(links, '(none)') || chr(10) AS line FROM heads
UNION ALL
SELECT r.seq, 1, u.part, '**Used by:** ' || u.used_by || chr(10)
FROM users u JOIN reach r USING (path)
UNION ALL
SELECT seq, 2, 0, '**Summary:**' || chr(10) || 'about ' || path || chr(10) FROM reach""",
    "a5_summary_sheet": X.CONTEXT + SHEET,
    "a7_missing_section": X.LINKS + f"""
SELECT dst AS missing, '- **' || dst || '**' || chr(10) || '  - Source: ' || source || chr(10)
  || '  - Reason wanted for review: imported as ' || spec AS line FROM ({_MISSING})""",
    "u1_union_needed": X.LINKS + """
SELECT src AS path, string_agg(dst, ', ' ORDER BY pos) || ', '
  || string_agg(spec, ', ' ORDER BY pos) AS needed FROM edges GROUP BY 1""",
    "u2_next_frontier": X.LINKS + """,
both_kinds AS (
  SELECT dst AS path, src AS parent, pos, 0 AS source_rank FROM edges
  UNION ALL
  SELECT 'src/parts/p' || o_custkey || '.ts', 'src/orders/o' || o_orderkey || '.ts', 0, 1
  FROM orders)
SELECT path, source_rank, parent, pos::BIGINT AS pos FROM both_kinds
QUALIFY row_number() OVER (PARTITION BY path ORDER BY source_rank, parent, pos) = 1""",
}

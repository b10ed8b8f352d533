"""Declaration index: what every extractor finds, and an extractor of one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.extract import html, java, javascript, typescript
from codeloom.operators import declarations as D
from codeloom.plans import corpora
from codeloom.plans.catalog import expected as X
from codeloom.plans.corpora import table


def _found(corpus: Callable, blocks: Callable[[Column], Column], *columns: str) -> Callable:
    """Query: the blocks of one kind over a corpus."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = D.explode_blocks(corpus(spark, sf_dir), blocks(F.col("content")))
        return rows.select("path", *(columns or ("text",)))

    return query


def _with_annotations(blocks: Callable[[Column], Column]) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = D.explode_blocks(corpora.java_classes(spark, sf_dir), blocks(F.col("content")))
        return rows.select(
            "path", "name", F.array_join("annotations", "|").alias("annotations"))

    return query


def e6_java_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _with_annotations(java.types)(spark, sf_dir)
    return types.unionByName(_with_annotations(java.signatures)(spark, sf_dir))


def _of_kind(blocks: Callable, kind: str) -> Callable[[Column], Column]:
    return lambda content: F.filter(blocks(content), lambda b: b["kind"] == kind)


def a6_structural_summary_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sections of every page in one text."""
    return D.summarized(corpora.jsp_pages(spark, sf_dir))


def a6_structural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summarized(corpora.js_modules(spark, sf_dir))


def declaration_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per file type and kind over all corpora, in one pass."""
    everything = (
        corpora.ts_modules(spark, sf_dir)
        .unionByName(corpora.js_modules(spark, sf_dir))
        .unionByName(corpora.java_classes(spark, sf_dir))
    )
    return D.declaration_index(everything).groupBy(
        F.regexp_extract("path", r"\w+$", 0).alias("ext"), "kind"
    ).agg(F.count("*").alias("n"))


def _headings(content: Column) -> Column:
    lines = F.regexp_extract_all(content, F.lit(r"(?m)^#+ .*$"), F.lit(0))
    return F.transform(lines, lambda t: F.struct(
        F.lit("heading").alias("kind"), F.regexp_extract(t, r"^#+ (.*)$", 1).alias("name"),
        t.alias("text")))


def h1_own_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.declaration_index(
        corpora.markdown_files(spark, sf_dir), D.BUILT_IN.adding(".md", _headings))
    return found.select("path", "pos", "kind", "name", "text")


def e7_extended_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modifiers, generic types with blanks, thrown types, type parameters; calls are none."""
    key = F.col("p_partkey").cast("string")
    classes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("src/Part"), key, F.lit(".java")).alias("path"),
        F.concat(
            F.lit("class Part"), key, F.lit(" {\n  private static Map<String, Long> tally"), key,
            F.lit("(int size) throws IOException {\n    return made(size);\n  }\n  protected Part"),
            key, F.lit("(long id) {\n    start(id);\n  }\n  public static <T> T first"), key,
            F.lit("(\n      List<T> of) {\n  }\n}\n")).alias("content"))
    found = D.explode_blocks(classes, java.signatures(F.col("content"), extended=True))
    return found.select("path", "kind", "name", "text")


_TS, _JS, _JAVA, _JSP = (
    corpora.ts_modules, corpora.js_modules, corpora.java_classes, corpora.jsp_pages)

QUERIES = {
    "e1_ts_imports": _found(_TS, typescript.imports),
    "e2_ts_types": _found(_TS, typescript.types, "name", "text"),
    "e2_ts_types_closed": _found(
        _TS, lambda c: typescript.types(c, closed=True), "name", "text"),
    "e3_ts_functions": _found(_TS, typescript.functions, "name", "text"),
    "e4_java_imports": _found(_JAVA, typescript.imports),
    "e5_java_types": _found(_JAVA, java.types, "name", "text"),
    "e6_java_annotations": e6_java_annotations,
    "e7_java_signatures": _found(
        _JAVA, _of_kind(java.signatures, "signature"), "name", "text"),
    "e7_extended_signatures": e7_extended_signatures,
    "e8_java_long_signatures": _found(
        _JAVA, _of_kind(java.signatures, "long_signature"), "name", "text"),
    "e9_js_imports": _found(_JS, typescript.imports),
    "e10_js_requires": _found(_JS, javascript.requires),
    "e11_js_comments": _found(_JS, javascript.comments),
    "e12_js_functions": _found(_JS, javascript.functions, "name", "text"),
    "e13_js_variables": _found(_JS, javascript.variables, "name", "text"),
    "e14_js_object_exports": _found(_JS, javascript.object_exports, "name", "text"),
    "e15_js_member_exports": _found(_JS, javascript.member_exports, "name", "text"),
    "e16_jsp_blocks": _found(_JSP, html.jsp),
    "e17_html_tags": _found(_JSP, html.tags, "pos", "text"),
    "e18_html_comments": _found(_JSP, html.comments),
    "e19_scripts": _found(_JSP, html.scripts),
    "e19_styles": _found(_JSP, html.styles),
    **{f.__name__: f for f in (
        a6_structural_summary, a6_structural_summary_html, declaration_index_counts,
        h1_own_extractor)},
}

_ORDER = "'src/orders/o' || o_orderkey || '.ts' AS path"
_PART = "'java/P' || p_partkey || '.java' AS path"
_SUPP = "'js/m' || s_suppkey || '.js' AS path"
_PAGE = "'pages/p' || page_id || '.jsp' AS path"
_NL = "chr(10)"


def _types(closed: bool) -> str:
    tail = f" || {_NL} || '}}'" if closed else ""
    return f"""
SELECT {_ORDER}, 'Basket' || o_orderkey AS name,
  'interface Basket' || o_orderkey || ' {{' || {_NL} || '  lines: string[];'{tail} AS text
FROM orders
UNION ALL SELECT {_ORDER}, 'Sealed' || o_orderkey,
  'interface Sealed' || o_orderkey || ' {{' || {_NL} || '}}' FROM orders
UNION ALL SELECT {_ORDER}, 'Due' || o_orderkey, 'type Due' || o_orderkey || ' = Date;' FROM orders
UNION ALL SELECT 'src/parts/p' || p_partkey || '.ts', 'Size' || p_partkey,
  'export type Size' || p_partkey || ' = ' || p_size || ';' FROM part"""


_VISIBLE = r"""
WITH v AS (SELECT page_id, regexp_replace('<%= ' || page_id || ' %>' || html,
  '(?is)<!--.*?(?:-->|\z)|(<script\b[^>]*>).*?(?:</script\s*>|\z)|(<style\b[^>]*>).*?(?:</style\s*>|\z)',
  '\1\2', 'g') AS html FROM pages),
t AS (SELECT page_id, html, unnest(regexp_extract_all(html, '<([a-zA-Z][^\s/>]*)[^>]*>', 0)) AS tag,
  generate_subscripts(regexp_extract_all(html, '<([a-zA-Z][^\s/>]*)[^>]*>', 0), 1) - 1 AS pos
  FROM v),
tags AS (SELECT page_id, pos, '<' || lower(regexp_extract(tag, '<([a-zA-Z][^\s/>]*)', 1))
  || CASE WHEN regexp_matches(tag, '^<[a-zA-Z][^\s/>]*[^>]*[^\s/>][^>]*>$')
          AND regexp_extract(tag, '^<[a-zA-Z][^\s/>]*([^>]*)>$', 1) <> ''
          AND regexp_matches(regexp_extract(tag, '^<[a-zA-Z][^\s/>]*([^>]*)>$', 1), '[^\s/]')
     THEN ' ...' ELSE '' END || '>' AS text FROM t)
"""
_BODY = r"unnest(regexp_extract_all(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1))"


def _union(select: str, source: str, *texts: str, names: tuple[str, ...] = ()) -> str:
    rows = []
    for i, t in enumerate(texts):
        name = f"{names[i]} AS name, " if names else ""
        rows.append(f"SELECT {select}, {name}{t} AS text FROM {source}")
    return "\nUNION ALL\n".join(rows)


def _exports(*names: str) -> str:
    return _union(_SUPP, "supplier", *[f"'export {n}' || s_suppkey || ';'" for n in names],
                  names=tuple(f"'{n}' || s_suppkey" for n in names))


ORACLES = {
    "e1_ts_imports": X.LINKS + """
SELECT src AS path, CASE
  WHEN spec = 'fs' THEN 'import fs from "fs";'
  WHEN left(spec, 8) = './nation' THEN 'import nation from "' || spec || '";'
  WHEN left(src, 9) = 'src/supp/' THEN 'import back from "' || spec || '";'
  ELSE 'import { ' || regexp_extract(spec, '([ps][0-9]+)(\\.js)?$', 1) || ' } from "' || spec || '";'
  END AS text FROM links WHERE src LIKE '%.ts' OR src LIKE '%.js'""",
    "e2_ts_types": _types(False),
    "e2_ts_types_closed": _types(True),
    "e3_ts_functions": f"""
SELECT {_ORDER}, 'tax' || o_orderkey AS name,
  'export function tax' || o_orderkey || '(net: number): number {{' AS text FROM orders""",
    "e4_java_imports": _union(
        _PART, "part", "'import java.time.Instant;'", "'import freight.kind.' || p_type || ';'"),
    "e5_java_types": _union(
        _PART, "part", "'public class Crate' || p_partkey || ' {'",
        "'interface Tariff' || p_partkey || ' {'",
        names=("'Crate' || p_partkey", "'Tariff' || p_partkey")),
    "e6_java_annotations": f"""
SELECT {_PART}, unnest(['Crate' || p_partkey, 'Tariff' || p_partkey, 'Crate' || p_partkey,
    'volume' || p_partkey, 'ship' || p_partkey, 'quote' || p_partkey]) AS name,
  unnest(['@Tracked|@Label("' || p_name || '")', '', '', '    @Cached(minutes = 5)',
    '    @Audited', '']) AS annotations FROM part""",
    "e7_java_signatures": _union(
        _PART, "part", "'    public Crate' || p_partkey || '(Route home) ;'",
        "'    public long volume' || p_partkey || '() ;'",
        "'    Money quote' || p_partkey || '(Route route);'",
        names=("'Crate' || p_partkey", "'volume' || p_partkey", "'quote' || p_partkey")),
    "e7_extended_signatures": """
SELECT 'src/Part' || p_partkey || '.java' AS path,
  unnest(['signature', 'signature', 'long_signature']) AS kind,
  unnest(['tally', 'Part', 'first']) || p_partkey AS name,
  unnest(['  private static Map<String, Long> tally' || p_partkey || '(int size) throws IOException ;',
    '  protected Part' || p_partkey || '(long id) ;',
    '  public static <T> T first' || p_partkey || '(' || chr(10) || '      List<T> of) ;']) AS text
FROM part""",
    "e8_java_long_signatures": f"""
SELECT {_PART}, 'ship' || p_partkey AS name, '    public void ship' || p_partkey || '(' || {_NL}
  || '        Route route,' || {_NL} || '        Instant start' || {_NL} || '    ) ;' AS text FROM part""",
    "e9_js_imports": f"""
SELECT {_SUPP}, 'import {{ stat }} from ''node:fs'';' AS text FROM supplier""",
    "e10_js_requires": f"""
SELECT {_SUPP}, 'const tally = require(''./tally-' || s_suppkey || ''');' AS text FROM supplier""",
    "e11_js_comments": _union(
        _SUPP, "supplier", "'//depot/' || s_suppkey || '\";'",
        "'// closing time of ' || s_suppkey",
        f"'/* Depot ' || s_suppkey || ': ' || s_name || {_NL} || '   opened once */'"),
    "e12_js_functions": f"""
SELECT {_SUPP}, 'weigh' || s_suppkey AS name,
  'export function weigh' || s_suppkey || '(crate, tare);' AS text FROM supplier""",
    "e13_js_variables": _union(
        _SUPP, "supplier",
        "'export let label' || s_suppkey || ' = \"' || s_name || '\";'",
        "'export var site' || s_suppkey || ' = \"ftp://depot/' || s_suppkey || '\";'",
        names=("'label' || s_suppkey", "'site' || s_suppkey")),
    "e14_js_object_exports": _exports("weigh", "heavy", "limit"),
    "e15_js_member_exports": _exports("depth", "close"),
    "e16_jsp_blocks": f"SELECT {_PAGE}, '<%= ' || page_id || ' %>' AS text FROM pages",
    "e17_html_tags": _VISIBLE + f"SELECT {_PAGE}, pos::INTEGER AS pos, text FROM tags",
    "e18_html_comments": f"""
SELECT {_PAGE}, unnest(regexp_extract_all(html, '(?s)<!--.*?-->', 0)) AS text FROM pages""",
    "e19_scripts": f"SELECT {_PAGE}, {_BODY.replace('{tag}', 'script')} AS text FROM pages",
    "e19_styles": f"SELECT {_PAGE}, {_BODY.replace('{tag}', 'style')} AS text FROM pages",
    "a6_structural_summary": f"""
SELECT {_SUPP}, array_to_string([
  'import {{ stat }} from ''node:fs'';',
  'const tally = require(''./tally-' || s_suppkey || ''');',
  '/* Depot ' || s_suppkey || ': ' || s_name || {_NL} || '   opened once */' || {_NL}
    || '//depot/' || s_suppkey || '";' || {_NL} || '// closing time of ' || s_suppkey,
  'export function weigh' || s_suppkey || '(crate, tare);',
  'export let label' || s_suppkey || ' = "' || s_name || '";' || {_NL}
    || 'export var site' || s_suppkey || ' = "ftp://depot/' || s_suppkey || '";',
  'export weigh' || s_suppkey || ';', 'export heavy' || s_suppkey || ';',
  'export limit' || s_suppkey || ';', 'export depth' || s_suppkey || ';',
  'export close' || s_suppkey || ';'], {_NL} || {_NL}) AS summary FROM supplier""",
    "a6_structural_summary_html": _VISIBLE + rf"""
, shown AS (SELECT page_id, string_agg(text, {_NL} ORDER BY pos) AS tags FROM tags GROUP BY 1)
SELECT {_PAGE}, 'JSP Blocks:' || {_NL} || '<%= ' || page_id || ' %>' || {_NL} || {_NL}
  || 'HTML Tags:' || coalesce({_NL} || tags, '') || {_NL} || {_NL}
  || array_to_string(list_concat(['Comments:'], regexp_extract_all(html, '(?s)<!--.*?-->', 0),
     ['', 'Scripts:'], regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1),
     ['', 'Styles:'], regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)), {_NL})
  AS summary
FROM pages LEFT JOIN shown USING (page_id)""",
    "declaration_index_counts": X.LINKS + """,
n(ext, kind, n) AS (
  SELECT regexp_extract(src, '[a-z]+$'), 'import', count(*) FROM links GROUP BY 1
  UNION ALL SELECT 'ts', 'type', 3 * count(*) FROM orders
  UNION ALL SELECT 'ts', 'type', count(*) FROM part
  UNION ALL SELECT 'ts', 'function', count(*) FROM orders
  UNION ALL SELECT 'java', 'import', 2 * count(*) FROM part
  UNION ALL SELECT 'java', 'type', 2 * count(*) FROM part
  UNION ALL SELECT 'java', 'signature', 3 * count(*) FROM part
  UNION ALL SELECT 'java', 'long_signature', count(*) FROM part
  UNION ALL SELECT 'js', 'variable', count(*) FROM supplier
  UNION ALL SELECT 'js', unnest(['import', 'require', 'comment', 'comment', 'comment',
    'function', 'variable', 'variable', 'object_export', 'object_export', 'object_export',
    'member_export', 'member_export']), count(*) FROM supplier)
SELECT ext, kind, sum(n)::BIGINT AS n FROM n GROUP BY 1, 2""",
    "h1_own_extractor": """
WITH t AS (SELECT conv_id, turn, '# Talk ' || conv_id || chr(10) || chr(10) || '## ' || role
  || chr(10) || chr(10) || text AS content FROM conversations),
l AS (SELECT conv_id, turn, list_filter(string_split(content, chr(10)),
  lambda x: regexp_matches(x, '^#+ ')) AS lines FROM t)
SELECT 'talks/c' || conv_id || '-' || turn || '.md' AS path,
  (generate_subscripts(lines, 1) - 1)::INTEGER AS pos, 'heading' AS kind,
  regexp_replace(unnest(lines), '^#+ ', '') AS name, unnest(lines) AS text FROM l""",
}

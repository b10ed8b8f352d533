"""SQL building blocks for the expected results: the truth behind the derived corpora,
written from the relational tables and not from the generated text."""

from __future__ import annotations

from codeloom.plans import corpora


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_text(template: str, **values: str) -> str:
    """Template as a SQL concatenation."""
    pieces, rest = [], template
    while rest:
        cuts = [rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest]
        if not cuts:
            pieces.append(quote(rest))
            break
        cut = min(cuts)
        if cut:
            pieces.append(quote(rest[:cut]))
        name = rest[cut + 1:rest.index("}", cut)]
        pieces.append(f"({values[name]})")
        rest = rest[cut + len(name) + 2:]
    return "(" + " || ".join(pieces) + ")"


_STAGE = """
op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
sp AS (SELECT l_suppkey AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1),
order_links AS (
  SELECT 'src/orders/o' || o_orderkey || '.ts' AS src, 0 AS pos, 'fs' AS spec, 'fs' AS dst
  FROM orders
  UNION ALL
  SELECT 'src/orders/o' || o || '.ts', row_number() OVER (PARTITION BY o ORDER BY p),
         '../parts/p' || p, 'src/parts/p' || p || '.ts'
  FROM op),
part_links AS (
  SELECT 'src/parts/p' || p || '.ts' AS src,
         row_number() OVER (PARTITION BY p ORDER BY s) - 1 AS pos,
         '../supp/s' || s || '.js' AS spec, 'src/supp/s' || s || '.js' AS dst
  FROM ps),
supplier_links AS (
  SELECT 'src/supp/s' || s_suppkey || '.js' AS src, 0 AS pos,
         './nation' || s_nationkey AS spec, 'src/supp/nation' || s_nationkey AS dst
  FROM supplier
  UNION ALL
  SELECT 'src/supp/s' || s || '.js', 1, '../parts/p' || p, 'src/parts/p' || p || '.ts'
  FROM sp),
links AS (
  SELECT * FROM order_links UNION ALL SELECT * FROM part_links
  UNION ALL SELECT * FROM supplier_links),
edges AS MATERIALIZED (SELECT * FROM links WHERE spec LIKE '.%'),
files AS (
  SELECT 'src/orders/o' || o_orderkey || '.ts' AS path FROM orders
  UNION ALL SELECT 'src/parts/p' || p_partkey || '.ts' FROM part
  UNION ALL SELECT 'src/supp/s' || s_suppkey || '.js' FROM supplier)"""

LINKS = f"WITH {_STAGE.strip()}\n"

ENTRY = "(SELECT 'src/orders/o' || min(l_orderkey) || '.ts' FROM lineitem)"

REACH = f"""WITH RECURSIVE {_STAGE.strip()},
reach(path, depth, parent, seq, chain) USING KEY (path) AS (
  SELECT {ENTRY}, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, {ENTRY}
  UNION
  SELECT path, depth, parent, base + row_number() OVER (ORDER BY first), chain
  FROM (
    SELECT e.dst AS path, min(r.depth) + 1 AS depth,
           arg_min(r.path, (r.seq, e.pos)) AS parent,
           arg_min(r.chain, (r.seq, e.pos)) || ' > ' || e.dst AS chain,
           min((r.seq, e.pos)) AS first,
           (SELECT max(x.seq) FROM recurring.reach x) AS base
    FROM reach r JOIN edges e ON e.src = r.path
    WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.path = e.dst)
    GROUP BY e.dst))
"""

PER_ROW = 20

# links and users of the reached files; users in rows of a bounded number
CONTEXT = REACH.rstrip() + f""",
pairs AS (
  SELECT DISTINCT e.dst, e.src, r.seq FROM edges e JOIN reach r ON r.path = e.src),
parts AS (
  SELECT dst AS path, seq // {PER_ROW} AS part, string_agg(src, ', ' ORDER BY seq) AS used_by
  FROM pairs GROUP BY 1, 2),
users AS (SELECT *, part = min(part) OVER (PARTITION BY path) AS is_first FROM parts),
file_links AS (
  SELECT src AS path, string_agg(dst, ', ' ORDER BY pos) AS links FROM edges GROUP BY 1)
"""

_N = "o_orderkey"
ORDER_TEXT = sql_text(
    corpora.ORDER_FILE, n=_N,
    imports="coalesce((SELECT string_agg('import { p' || p || ' } from \"../parts/p' || p"
            " || '\";' || chr(10), '' ORDER BY p) FROM op WHERE o = o_orderkey), '')",
)
JS_TEXT = sql_text(corpora.JS_FILE, n="s_suppkey", name="s_name")

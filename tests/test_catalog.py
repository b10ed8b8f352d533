"""Catalog queries on tables of a few rows."""

from __future__ import annotations

from codeloom.plans.catalog import links


def write_tables(spark, folder, items):
    """Orders, parts and suppliers of ``items`` (order, part, supplier); nation 3 for all."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    keys = [sorted({item[k] for item in items}) for k in range(3)]
    write("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long")
    write("orders", [(k,) for k in keys[0]], "o_orderkey long")
    write("part", [(k, 1) for k in keys[1]], "p_partkey long, p_size int")
    write("supplier", [(k, 3, "name") for k in keys[2]],
          "s_suppkey long, s_nationkey int, s_name string")
    write("nation", [(3,)], "n_nationkey int")
    return str(folder)


def test_needed_files_are_links_and_then_specifiers(spark, tmp_path):
    """Both sides of the union are in its result: specifiers are no links of the file."""
    at = write_tables(spark, tmp_path, [(1, 6, 9), (1, 5, 9), (2, 6, 8)])
    got = {r.path: r.needed for r in links.u1_union_needed(spark, at).collect()}
    assert got == {
        "src/orders/o1.ts": "src/parts/p5.ts, src/parts/p6.ts, ../parts/p5, ../parts/p6",
        "src/orders/o2.ts": "src/parts/p6.ts, ../parts/p6",
        "src/parts/p5.ts": "src/supp/s9.js, ../supp/s9.js",
        "src/parts/p6.ts": "src/supp/s8.js, src/supp/s9.js, ../supp/s8.js, ../supp/s9.js",
        "src/supp/s8.js": "src/supp/nation3, src/parts/p6.ts, ./nation3, ../parts/p6",
        "src/supp/s9.js": "src/supp/nation3, src/parts/p5.ts, ./nation3, ../parts/p5",
    }

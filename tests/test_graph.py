"""Links and walks against plain Python on small graphs."""

from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from codeloom.operators import graph, links, ordering
from codeloom.session import stored_by


def edges_df(spark, pairs):
    """Edges in the order given; the position counts per source."""
    rows, seen = [], {}
    for src, dst in pairs:
        seen[src] = seen.get(src, -1) + 1
        rows.append((src, seen[src], dst, dst, True))
    return spark.createDataFrame(
        rows, "src string, pos long, spec string, dst string, is_relative boolean")


def queue_walk(pairs, entries):
    """(path, depth, parent) in the order of a first-in-first-out queue."""
    out = {}
    for src, dst in pairs:
        out.setdefault(src, []).append(dst)
    found, queue = {}, deque((e, 0, None) for e in entries)
    while queue:
        path, depth, parent = queue.popleft()
        if path in found:
            continue
        found[path] = (depth, parent)
        queue.extend((d, depth + 1, path) for d in out.get(path, []))
    return [(p, *found[p]) for p in found]


def walked(df):
    return [(r["path"], r["depth"], r["parent"]) for r in df.orderBy("seq").collect()]


def test_walk_of_cycle_self_loop_and_unreachable(spark):
    pairs = [("a", "b"), ("b", "b"), ("b", "c"), ("c", "a"), ("x", "y")]
    df = graph.breadth_first(edges_df(spark, pairs), ["a"], chains=True)
    assert walked(df) == queue_walk(pairs, ["a"])
    assert {r["path"]: r["chain"] for r in df.collect()} == {
        "a": "a", "b": "a > b", "c": "a > b > c"}
    assert [r["seq"] for r in df.orderBy("seq").collect()] == [0, 1, 2]


def test_walk_of_random_graph_equals_queue(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)]
    entries = ["n5", "n1", "n5"]
    df = graph.breadth_first(edges_df(spark, pairs), entries)
    assert walked(df) == queue_walk(pairs, entries)


def test_long_chain_and_depth_limit(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(10)]
    edges = edges_df(spark, pairs)
    assert walked(graph.breadth_first(edges, ["n0"])) == queue_walk(pairs, ["n0"])
    assert graph.breadth_first(edges, ["n0"], max_depth=3).count() == 4


def test_dense_index_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    numbered, total = ordering.with_dense_index(df, ["v"], "n", 5)
    assert total == 1000
    assert [(r["v"], r["n"]) for r in numbered.orderBy("v").collect()] == [
        (i, i + 5) for i in range(1000)]
    empty, none = ordering.with_dense_index(df.filter("v < 0"), ["v"], "n")
    assert (empty.count(), none) == (0, 0)


def test_hot_target_is_split_and_complete(spark):
    """A target that a third of all files use gets rows of a bounded size."""
    pairs = [(f"f{i}", "hot" if i % 3 == 0 else f"f{i % 7}") for i in range(300)]
    edges = edges_df(spark, pairs)
    order = spark.createDataFrame([(f"f{i}", i) for i in range(300)], "path string, seq long")
    rows = graph.used_by(edges, order, per_row=20).collect()
    assert max(len(r["used_by"].split(", ")) for r in rows if r["path"] == "hot") <= 20
    assert {r["part"] for r in rows if r["path"] == "hot"} == set(range(15))
    first, further = graph.first_and_further(graph.used_by(edges, order, per_row=20))
    assert {r["part"] for r in first.collect() if r["path"] == "hot"} == {0}
    assert first.count() + further.count() == len(rows)
    for target in {d for _, d in pairs}:
        parts = sorted((r["part"], r["used_by"]) for r in rows if r["path"] == target)
        assert ", ".join(p[1] for p in parts).split(", ") == [s for s, d in pairs if d == target]


def files_df(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def test_resolution(spark):
    files = files_df(spark, {
        "src/a.ts": 'import x from "./b";\nimport "./c"\nimport y from "../lib/d.js";\n'
                    "import z from './none';\nimport fs from \"fs\";\nimport '/abs';\n"
                    "import q from './both';\nimport j from './data.json';",
        "src/b.js": "", "src/c.ts": "", "lib/d.js": "", "src/both.ts": "", "src/both.js": "",
        "src/data.json": "", "b.ts": ""})
    rows = links.import_edges(files).orderBy("pos").collect()
    assert [(r["spec"], r["dst"], r["resolved"], r["link_class"]) for r in rows] == [
        ("./b", "src/b.js", True, "relative"),
        ("./c", "src/c.ts", True, "relative"),
        ("../lib/d.js", "lib/d.js", True, "relative"),
        ("./none", "src/none", False, "relative"),
        ("fs", "fs", False, "library"),
        ("/abs", "/abs", False, "absolute"),
        ("./both", "src/both.ts", True, "relative"),
        ("./data.json", "src/data.json", True, "relative"),
    ]
    root = links.import_edges(files, "root").orderBy("pos").collect()
    assert [r["dst"] for r in root][:4] == ["b.ts", "c", "../lib/d.js", "none"]


def test_forms_that_are_no_links(spark):
    files = files_df(spark, {
        "a.js": "const x = require('./r');\nexport { y } from './y';\nimport {\n z\n} from './z';\n"
                "  import s from './s';\nimport('./dyn');"})
    assert links.extract_links(files).count() == 0


def pre_order(rows):
    """(path, place, size) of a tree, plainly."""
    under = {}
    for path, parent, seq in sorted(rows, key=lambda r: r[2]):
        under.setdefault(parent, []).append(path)
    order, size = [], {}

    def visit(path):
        order.append(path)
        size[path] = 1 + sum(visit(p) for p in under.get(path, []))
        return size[path]

    for path in under.get(None, []):
        visit(path)
    return sorted((p, i, size[p]) for i, p in enumerate(order))


def test_trace_order_of_random_trees(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(170)]
    pairs += [(f"d{i}", f"d{i + 1}") for i in range(9)]  # deep, besides the wide part
    tree = graph.breadth_first(edges_df(spark, pairs), ["n5", "d0", "n77"]).select(
        "path", "parent", "seq")
    got = graph.trace_order(tree)
    assert sorted((r["path"], r["preorder"], r["subtree"]) for r in got.collect()) == pre_order(
        [tuple(r) for r in tree.collect()])
    assert graph.trace_order(tree.limit(0)).count() == 0


def test_missing_targets_of_resolved_edges(spark):
    edges = edges_df(spark, [("a", "b"), ("c", "gone"), ("b", "gone")]).withColumn(
        "resolved", F.col("dst") != "gone")
    assert [tuple(r) for r in graph.missing_targets(edges).collect()] == [
        ("gone", "b", "imported as gone", 2)]


def test_users_of_repeated_and_outside_links(spark):
    edges = edges_df(spark, [("a", "x"), ("a", "x"), ("out", "x"), ("b", "x")])
    order = spark.createDataFrame([("b", 0), ("a", 1), ("x", 2)], "path string, seq long")
    assert [tuple(r) for r in graph.used_by(edges, order).collect()] == [("x", 0, "b, a")]


def test_missing_and_unexplored_and_frontier(spark):
    edges = edges_df(spark, [("a", "b"), ("c", "gone"), ("b", "gone"), ("a", "c")])
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    lost = graph.missing_targets(edges, files).collect()
    assert [tuple(r) for r in lost] == [("gone", "b", "imported as gone", 2)]
    wanted = spark.createDataFrame(
        [("a", "summary"), ("a", "full"), ("b", "summary")], "path string, aspect string")
    done = spark.createDataFrame([("a", "summary"), ("a", "summary")], "path string, aspect string")
    assert sorted(tuple(r) for r in graph.unexplored(wanted, done).collect()) == [
        ("a", "full"), ("b", "summary")]
    linked = spark.createDataFrame([("x", "b", 0), ("x", "a", 1)], "path string, parent string, pos long")
    needed = spark.createDataFrame([("x", "A", 0), ("y", "c", 0)], "path string, parent string, pos long")
    assert sorted(tuple(r) for r in graph.next_frontier(linked, needed).collect()) == [
        ("x", 0, "a", 1), ("y", 1, "c", 0)]


def test_edges_stored_by_source_are_not_shuffled_again(spark):
    """Neither a level nor a group by source moves the links; only a level's files move."""
    pairs = [(f"n{i}", f"n{(i * 7 + k) % 50}") for i in range(50) for k in range(3)]
    edges = stored_by(edges_df(spark, pairs), "src", "edges")
    level = spark.range(5).selectExpr("concat('n', id) AS src")
    plan = edges.join(level.hint("shuffle_hash"), "src")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Sort " not in plan
    plan = graph.links_per_file(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    walk = graph.breadth_first(edges, ["n3"], by_source=True)
    assert walked(walk) == queue_walk(pairs, ["n3"])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]

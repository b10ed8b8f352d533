"""Files on disk, bundles, notes, reports and reviews."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.plans import report
from codeloom.sources import files as S
from codeloom.sources import sinks as K
from codeloom.sources import tree as tree_module


@pytest.fixture
def tree(tmp_path):
    content = {
        "a.ts": b"import x from './b';\r\n", "sub/B.TS": b"", "sub/p=1/c.js": b"let c;\n",
        "no_ext": b"plain", "with space+plus%41.md": b"# t", "bad.txt": b"ok\xff\xfe",
        "_skipped.ts": b"x", "sub/.hidden": b"x",
    }
    for name, data in content.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return tmp_path


def test_list_files(spark, tree):
    def listed(*args):
        return sorted(r["path"] for r in S.list_files(spark, str(tree), *args).collect())

    everything = ["a.ts", "bad.txt", "no_ext", "sub/B.TS", "sub/p=1/c.js", "with space+plus%41.md"]
    assert listed() == everything
    assert listed("sub") == ["sub/B.TS", "sub/p=1/c.js"]
    assert listed("sub", "p=1") == ["sub/B.TS"]
    assert listed({"regexp": r"\.ts$", "flags": "i"}) == ["a.ts", "sub/B.TS"]
    assert listed({"regexp": f"^{tree}/[^/]*$"}, "with") == ["a.ts", "bad.txt", "no_ext"]
    assert listed(tree.name) == []  # text filters do not see the folder
    sizes = {r["path"]: r["size"] for r in S.list_files(spark, f"file:{tree}/").collect()}
    assert sizes["no_ext"] == 5


def test_listing_reads_no_content(spark, tree):
    plan = S.list_files(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    assert "content:binary" not in plan


def test_read_files(spark, tree):
    got = {r["path"]: r["content"] for r in S.read_files(spark, str(tree)).collect()}
    assert got["a.ts"] == "import x from './b';\r\n" and got["sub/B.TS"] == ""
    assert got["bad.txt"] == "ok��"
    both = S.read_files(spark, str(tree), [".ts", ".js"]).collect()
    assert sorted(r["path"] for r in both) == ["a.ts", "sub/B.TS", "sub/p=1/c.js"]
    assert [r["path"] for r in S.read_files(spark, str(tree), [".js"]).collect()] == [
        "sub/p=1/c.js"]


def test_requested_reads(spark, tree):
    files = S.read_files(spark, str(tree))
    asked = spark.createDataFrame([(0, "no_ext"), (1, "gone"), (2, "no_ext")], "position int, path string")
    rows = S.read_requested(asked, files).orderBy("position").collect()
    assert [(r["content"], r["error"]) for r in rows] == [
        ("plain", None), (None, "not found"), ("plain", None)]
    assert S.read_requested(asked, files, "skip").count() == 2
    bundle = S.render_bundle(
        S.read_requested(asked, files).withColumn("bundle_id", F.lit(1)), per_part=2)
    parts = [r["text"] for r in bundle.orderBy("part").collect()]
    assert "\n\n".join(parts) == (
        "--- FILE: no_ext ---\nplain\n\n\n--- FILE: gone ---\nError: not found\n"
        "\n\n--- FILE: no_ext ---\nplain\n")


def test_only_requested_contents_are_shuffled(spark, tree):
    asked = spark.createDataFrame([(0, "no_ext")], "position int, path string")
    plan = S.read_requested(asked, S.read_files(spark, str(tree)))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_notes_run_twice(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a/x.ts", "note"), ("b/x.js", "  "), ("c", None)], "path string, body string")
    for run in ("2024-01-01-00", "2024-01-01-01", "2024-01-01-00"):
        K.write_notes(rows, str(tmp_path), run)
    got = K.read_notes(spark, str(tmp_path)).filter("run_id = '2024-01-01-00'").collect()
    assert sorted((r["path"], r["note"]) for r in got) == [
        ("a/x.ts", "note"), ("b/x.js", "# No explanation available."),
        ("c", "# No explanation available.")]


def test_review_versions(spark, tmp_path):
    at = datetime.datetime
    first = spark.createDataFrame(
        [("s1", "long body", at(2024, 1, 1), "r1"), ("s2", "b", at(2024, 1, 1), "r1")],
        "section_key string, body string, updated_at timestamp, reason string")
    second = spark.createDataFrame(
        [("s1", "short", at(2024, 1, 2), "r2"), ("s2", "c", at(2024, 1, 2), "r2")], first.schema)
    K.write_review(spark, str(tmp_path), None, "1", first)
    for _ in range(2):  # a repeated step changes nothing
        final = K.write_review(spark, str(tmp_path), "1", "2", second)
    assert sorted((r["section_key"], r["body"]) for r in final.collect()) == [
        ("s1", "long body"), ("s2", "c")]
    history = spark.read.parquet(f"{tmp_path}/history")
    assert sorted(r["entry"] for r in history.collect()) == [
        "- 2024-01-01T00:00:00.000Z: r1"] * 2 + ["- 2024-01-02T00:00:00.000Z: r2"] * 2


def test_rendered_review_text(spark, tmp_path):
    """Bodies by section, then the history by time."""
    at = datetime.datetime
    updates = spark.createDataFrame(
        [("s2", " second \n", at(2024, 1, 2), "later"), ("s1", "first\nlines", at(2024, 1, 1), "made")],
        "section_key string, body string, updated_at timestamp, reason string")
    sections = K.merge_review(None, updates)
    K.write_rendered_review(
        report.review_lines(sections, K.history_lines(updates)), str(tmp_path), "1")
    parts = sorted((tmp_path / "text" / "version=1").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == """first
lines

second

## History

- 2024-01-01T00:00:00.000Z: made
- 2024-01-02T00:00:00.000Z: later
"""


def test_files_summary_text(spark, tmp_path):
    edges = spark.createDataFrame(
        [("a.ts", 0, "b.ts"), ("a.ts", 1, "c")], "src string, pos long, dst string")
    order = spark.createDataFrame([("a.ts", 0), ("b.ts", 1)], "path string, seq long")
    about = spark.createDataFrame(
        [("a.ts", "A", "e", "u", "x", "f"), ("b.ts", "B", "", "", "", "")],
        "path string, title string, explanation string, use_case string, abstraction string,"
        " functions_used string")
    K.write_report(report.files_summary(order, about, edges).withColumn(
        "report", F.lit("files-summary")), str(tmp_path), "r")
    parts = sorted((tmp_path / "run_id=r" / "report=files-summary").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == (
        "# File Summaries\n\n## A (a.md)\n\n**Explanation:**\ne\n\n**Use Case:**\nu\n\n"
        "**Abstraction/Responsibility:**\nx\n\n**Functions/Abstractions Used:**\nf\n\n"
        "**Imports:**\n- b.ts\n- c\n\n"
        "## B (b.md)\n\n**Explanation:**\n\n\n**Use Case:**\n\n\n"
        "**Abstraction/Responsibility:**\n\n\n**Functions/Abstractions Used:**\n\n\n"
        "**Imports:**\n(none)\n\n")


def test_report_text(spark, tmp_path):
    """The whole text of a small report, as read from the files in name order."""
    edges = spark.createDataFrame(
        [("a.ts", 0, "./b", "b.ts", True), ("a.ts", 1, "./gone", "gone", True),
         ("b.ts", 0, "./a", "a.ts", True)],
        "src string, pos long, spec string, dst string, is_relative boolean")
    order = spark.createDataFrame([("a.ts", 0), ("b.ts", 1)], "path string, seq long")
    summaries = spark.createDataFrame([("a.ts", "first"), ("b.ts", "")], "path string, summary string")
    lines = report.path_summary(
        order, edges, graph.used_by(edges, order), summaries,
        graph.missing_targets(edges, order.select("path")), "a.ts",
    ).withColumn("report", F.lit("path-summary"))
    K.write_report(lines, str(tmp_path), "r")
    parts = sorted((tmp_path / "run_id=r" / "report=path-summary").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == """# General Overview

This codebase consists of the following researched files and their relationships:

- **a.ts** imports/links to: b.ts, gone | used by: b.ts
- **b.ts** imports/links to: a.ts | used by: a.ts

The dependency graph shows how files are interconnected, with arrows indicating import or usage relationships. Entry file: **a.ts**.
# Code Chain Map

- **a.ts**
  - links to: b.ts
  - links to: gone
  - used by: b.ts
- **b.ts**
  - links to: a.ts
  - used by: a.ts

# File Summaries

## a.ts

**Links to:** b.ts, gone

**Used by:** b.ts

**Summary:**
first

## b.ts

**Links to:** a.ts

**Used by:** a.ts

**Summary:**



# Missing Files

- **gone**
  - Source: a.ts
  - Reason wanted for review: imported as ./gone
"""


def test_extensions_of_any_case_and_number(spark, tmp_path):
    for name in ("a.ts", "B.TS", "c.js", "d.Ts"):
        (tmp_path / name).write_text(name)
    for wanted in ([".ts"], [".ts", ".md"], [".TS"]):
        got = S.read_files(spark, str(tmp_path), wanted).collect()
        assert sorted(r["path"] for r in got) == ["B.TS", "a.ts", "d.Ts"], wanted


def test_notes_lose_all_surrounding_whitespace(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "\n\n"), ("b", "\tx\n"), ("c", None)], "path string, body string")
    K.write_notes(rows, str(tmp_path / "n"), "r")
    got = {r["path"]: r["note"] for r in K.read_notes(spark, str(tmp_path / "n")).collect()}
    assert got == {"a": "# No explanation available.", "b": "x",
                   "c": "# No explanation available."}


def _times(folder):
    """Files below ``folder`` that were opened since ``_close`` (access time)."""
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*")
                  if p.is_file() and p.stat().st_atime > 1000)


def _close(folder):
    import os

    for p in folder.rglob("*"):
        if p.is_file():
            os.utime(p, (1, p.stat().st_mtime))


@pytest.mark.parametrize("at_once", [1, 20_000])
def test_walk_equals_the_tree(spark, tree, monkeypatch, at_once):
    from codeloom.sources import tree as W

    monkeypatch.setattr(W, "ENTRIES_AT_ONCE", at_once)
    (tree / "sub" / "deep" / "er").mkdir(parents=True)
    (tree / "sub" / "deep" / "er" / "e.ts").write_bytes(b"")
    (tree / "sub" / "deep" / "up").symlink_to(tree)
    want = {str(p.relative_to(tree)): p.stat().st_size for p in tree.rglob("*") if p.is_file()}
    got = {r["path"]: r["size"] for r in W.walk(spark, str(tree), hidden=True).collect()}
    assert got == want
    shown = {p for p in want if not any(part[0] in "_." for part in p.split("/"))}
    assert {r["path"] for r in W.walk(spark, f"file:{tree}").collect()} == shown
    with pytest.raises(ValueError):
        W.walk(spark, "hdfs://x/y")


def test_only_what_is_asked_for_is_opened(spark, tree):
    from codeloom.sources import tree as W

    asked = spark.createDataFrame(
        [(0, "no_ext"), (1, "gone"), (2, "no_ext"), (3, "sub/.hidden")], "position int, path string")
    _close(tree)
    rows = S.read_requested_from(spark, asked, str(tree)).orderBy("position").collect()
    assert [(r["content"], r["error"]) for r in rows] == [
        ("plain", None), (None, "not found"), ("plain", None), ("x", None)]
    assert set(_times(tree)) <= {"no_ext", "sub/.hidden"}
    _close(tree)
    rows = W.search_chunks_from(spark, str(tree), "cjs", 1).collect()
    assert [(r["rank"], r["path"], r["chunk"]) for r in rows] == [(1, "sub/p=1/c.js", "let c;")]
    assert set(_times(tree)) <= {"sub/p=1/c.js"}
    read = {r["path"]: r["content"] for r in W.read_tree(spark, str(tree), [".ts"]).collect()}
    assert read == {"a.ts": "import x from './b';\r\n", "sub/B.TS": ""}
    bad = W.read_tree(spark, str(tree), include="bad").first()
    assert bad["content"] == "ok��"


def test_listing_brings_no_name_to_the_driver(spark, tree, monkeypatch):
    from pyspark.sql import DataFrame

    def refuse(self, *args):
        raise AssertionError("names on the driver")

    for name in ("inputFiles", "collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, refuse)
    listed = S.list_files(spark, str(tree))
    monkeypatch.undo()
    assert listed.count() == 6


def test_folders_are_written_by_tasks(spark, tmp_path):
    """One file a folder, rows of a folder together, nothing but named files, twice the same."""
    rows = spark.createDataFrame(
        [(f"file=m{i % 40}.js", f"line {i % 40}") for i in range(80)] + [("file=n", None)],
        "folder string, value string").repartition(7)
    for _ in range(2):
        tree_module.write_folders(rows, f"file:{tmp_path}/t")
    found = [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    assert len(found) == 41 and {p.name for p in found} == {"part-00000.txt"}
    got = {r["path"]: r["content"] for r in S.read_files(spark, f"{tmp_path}/t", [".txt"]).collect()}
    assert got == {f"file=m{i}.js/part-00000.txt": f"line {i}\n" * 2 for i in range(40)} | {
        "file=n/part-00000.txt": "\n"}

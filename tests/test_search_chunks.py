"""Fuzzy search and chunks against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import chunks, search


def score(path, query):
    name, q = path.lower(), query.lower()
    if name == q:
        return 1
    spans = []
    for start in range(len(name)):
        if name[start] != q[0]:
            continue
        at = start
        for c in q[1:]:
            at = name.find(c, at + 1)
            if at < 0:
                break
        else:
            spans.append((at - start, start))
    if not spans:
        return None
    return 2 + (min(spans)[0] if len(q) > 1 else spans[0][1])


def some_paths():
    rng = random.Random(5)
    return sorted({"".join(rng.choices("abC./x(", k=rng.randint(1, 12))) for _ in range(150)})


QUERIES = ["ab", "a", "Cx", "abc", ".", "(x", "zzz", "a.b", "aa"]


def test_fuzzy_search(spark):
    names = some_paths()
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for query in QUERIES:
        wanted = sorted((score(n, query), n) for n in names if score(n, query))
        got = [(r["score"], r["path"]) for r in search.fuzzy_search(df, query, None).collect()]
        assert got == wanted, query
        assert search.fuzzy_search(df, query, 3).count() == min(3, len(wanted))
    assert search.fuzzy_search(df, "", None).count() == len(names)
    exact = spark.createDataFrame([("src/A.ts",), ("src/a.tsx",)], "path string")
    assert [tuple(r) for r in search.fuzzy_search(exact, "SRC/a.ts").collect()] == [
        ("src/A.ts", 1), ("src/a.tsx", 9)]


def test_fuzzy_batch_equals_single_searches(spark):
    names = some_paths()
    df = spark.createDataFrame([(n,) for n in names], "path string")
    asked = spark.createDataFrame([(q,) for q in QUERIES + ["ab", ""]], "query string")
    got = {}
    for r in search.fuzzy_search_batch(df, asked, 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["score"], r["path"]))
    for query in QUERIES:
        best = sorted((score(n, query), n) for n in names if score(n, query))[:4]
        wanted = [(i, s, n) for i, (s, n) in enumerate(best, 1)]
        assert sorted(got.get(query, [])) == wanted, query
    assert sorted(got[""]) == [(i, None, n) for i, n in enumerate(sorted(names)[:4], 1)]


def test_fuzzy_batch_limits_ranks_before_the_shuffle(spark):
    df = spark.createDataFrame([("a",)], "path string")
    asked = spark.createDataFrame([("a",)], "query string")
    plan = search.fuzzy_search_batch(df, asked, 4)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_regex_search(spark):
    df = spark.createDataFrame(
        [("a.ts", "Foo\nbar"), ("b.js", "foo"), ("c.ts", None)], "path string, content string")
    assert [r[0] for r in search.regex_search(df, "foo", "gi", [".ts"]).collect()] == ["a.ts"]
    assert [r[0] for r in search.regex_search(df, "^bar", "m").collect()] == ["a.ts"]
    assert search.regex_search(df, "^bar").count() == 0
    odd = spark.createDataFrame(
        [("end", "foo;\n"), ("upper", "\u00c9T\u00c9"), ("space", "a\u00a0b"), ("class", "x[$")],
        "path string, content string")
    for pattern, flags, wanted in [
        ("foo;$", None, []), ("foo;$", "m", ["end"]), ("\u00e9t\u00e9", "i", ["upper"]),
        (r"a\sb", "", ["space"]), (r"a\Sb", "", []), ("[[][$]", "", ["class"])]:
        assert [r[0] for r in search.regex_search(odd, pattern, flags).collect()] == wanted
    for flags in ("x", "ii"):
        with pytest.raises(ValueError):
            search.regex_search(odd, "a", flags)
    hits = search.regex_search_all(df, {"f": ("foo", "i"), "b": ("bar", None)}).collect()
    assert sorted(tuple(r) for r in hits) == [("a.ts", "b"), ("a.ts", "f"), ("b.js", "f")]


def test_symbol_usage(spark):
    files = spark.createDataFrame(
        [("a.ts", "x = total(y)"), ("b.ts", "total total2"), ("c.js", "total")],
        "path string, content string")
    names = spark.createDataFrame([("total",), ("total",), ("gone",), (None,)], "name string")
    assert sorted(tuple(r) for r in search.symbol_usage(files, names, [".ts"]).collect()) == [
        ("total", "a.ts"), ("total", "b.ts")]


def windows(text, size, overlap):
    if not text:
        return []
    step = size - overlap
    found = [text[0:size]]
    start = step
    while start < len(text) - overlap:
        found.append(text[start:start + size])
        start += step
    return found


def test_fixed_windows(spark):
    cases = ["", "a", "x" * 10, "abcdefghij" * 3, "é" * 25, "y" * 11]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    for r in df.select("i", chunks.fixed_windows(F.col("t"), 10, 3).alias("w")).collect():
        assert r["w"] == windows(cases[r["i"]], 10, 3)
        joined = r["w"][0] + "".join(w[3:] for w in r["w"][1:]) if r["w"] else ""
        assert joined == cases[r["i"]]


def split_before(text, pattern):
    cuts = [m.start() for m in re.finditer(pattern, text) if 0 < m.start()]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def pieces(text, boundary, size, cell):
    parts = [text]
    for pattern in (boundary, r"(?=\n\n)", r"(?=\n)"):
        parts = [q for p in parts for q in ([p] if len(p) <= size else split_before(p, pattern))]
    cells = re.compile(rf"(?s).{{1,{cell}}}(?= |\Z)|.{{1,{cell}}}")
    return [q for p in parts for q in ([p] if len(p) <= size else cells.findall(p))]


def packed(parts, size, overlap):
    done, open_, shared = [], [], 0
    for p in parts:
        if sum(map(len, open_)) + len(p) > size:
            done.append(("".join(open_), shared))
            room, kept = min(overlap, size - len(p)), []
            for q in reversed(open_):
                if sum(map(len, kept)) + len(q) > room:
                    break
                kept.insert(0, q)
            open_, shared = kept, sum(map(len, kept))
        open_.append(p)
    return done + [("".join(open_), shared)] if open_ else done


def test_code_chunks(spark):
    rng = random.Random(9)
    tokens = ["function f", "\nfunction ", "\nconst x", "\n", "\n\n", " ", "word", "long" * 12, "é"]
    cases = ["".join(rng.choices(tokens, k=rng.randint(1, 80))) for _ in range(60)]
    cases += ["", "z" * 95, "a b " * 30]
    boundary = r"(?=\nfunction |\nconst |\nlet |\nvar |\nclass |\nif |\nfor |\nwhile |\nswitch |\ncase |\ndefault )"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    rows = df.select("i", chunks.code_pieces(F.col("t"), F.lit("js"), 40, 10).alias("c")).collect()
    for r in rows:
        text = cases[r["i"]]
        wanted = packed(pieces(text, boundary, 40, 10), 40, 10) if text else []
        assert [(c["chunk"], c["overlap"]) for c in r["c"]] == wanted, text
        assert "".join(c["chunk"][c["overlap"]:] for c in r["c"]) == text
        assert all(len(c["chunk"]) <= 40 and c["overlap"] <= 10 for c in r["c"])


def test_unknown_language_falls_back_to_lines(spark):
    df = spark.createDataFrame(
        [("a.txt", "x\r\n\n \ny"), ("b.py", "def f():\n pass")], "path string, content string")
    rows = chunks.chunk_files(df, "code").orderBy("path", "chunk_index").collect()
    assert [(r["path"], r["chunk_index"], r["chunk"]) for r in rows] == [
        ("a.txt", 0, "x"), ("a.txt", 1, " "), ("a.txt", 2, "y"), ("b.py", 0, "def f():\n pass")]


def test_fetch_and_search_chunks(spark):
    files = spark.createDataFrame(
        [("src/one.ts", "a\nb"), ("src/other.ts", "c"), ("x.py", "d")],
        "path string, content string")
    asked = spark.createDataFrame(
        [("src/one.ts", 1), ("src/one.ts", 5), ("gone", 0)], "path string, chunk_index int")
    got = chunks.fetch_chunks(asked, files).orderBy("path", "chunk_index").collect()
    assert [tuple(r) for r in got] == [
        ("gone", 0, ""), ("src/one.ts", 1, "b"), ("src/one.ts", 5, "")]
    found = chunks.search_chunks(files, "ots", 2, "lines").collect()
    assert [(r["path"], r["chunk"]) for r in found] == [
        ("src/one.ts", "a"), ("src/one.ts", "b"), ("src/other.ts", "c")]


def test_fuzzy_batch_never_gathers_the_letters_of_paths(spark, monkeypatch):
    """However small the table of paths is, only the queries are sent to all tasks."""
    names = some_paths()
    df = spark.createDataFrame([(n,) for n in names], "path string")
    asked = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    wanted = sorted((q, s, n) for q in QUERIES for n in names if (s := score(n, q)))
    for few, join in ((10_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(search, "FEW_QUERIES", few)
        found = search.fuzzy_search_batch(df, asked, top_n=1000)
        got = sorted((r["query"], r["score"], r["path"]) for r in found.collect())
        assert got == wanted
        plan = found._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "letter" in line and "Join" in line]
        assert joins and all(join in line for line in joins)
        assert not any("BuildLeft" in line for line in joins)

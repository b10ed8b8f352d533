"""Path and text functions, with properties checked against the standard library."""

from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import filters, paths, text


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_extension_and_stem(spark):
    inputs = ["a/b.d.ts", ".x", "a/.x", "..", "a/..foo", "x.", "b/c", "a.b/c", "X.JAVA"]
    assert values(spark, paths.extension, inputs) == [
        ".ts", "", "", "", ".foo", ".", "", "", ".JAVA"]
    assert values(spark, paths.stem, inputs) == [
        "b.d", ".x", ".x", "..", ".", "x", "c", "c", "X"]
    assert values(spark, paths.directory, ["a/b/c", "c", "/c", ""]) == ["a/b", "", "", ""]


def _random_paths(n):
    rng = random.Random(7)
    pieces = ["a", "b.c", "..", ".", "", "x y", "..."]
    return ["/".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(n)]


def test_normalize_agrees_with_posixpath(spark):
    inputs = [p for p in _random_paths(600) if p]
    for path, got in zip(inputs, values(spark, paths.normalize_path, inputs)):
        wanted = posixpath.normpath(path)
        if wanted.startswith("//"):
            wanted = wanted[1:]
        assert got.rstrip("/") == wanted.rstrip("/"), path
        # a trailing slash is kept
        assert got.endswith("/") == (path.endswith("/") or got == "/"), path


def test_relative_agrees_with_posixpath(spark):
    absolute = ["/" + p for p in _random_paths(300)]
    pairs = list(zip(absolute, reversed(absolute)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", paths.relative_path(F.col("a"), F.col("b")).alias("r")).collect():
        wanted = posixpath.relpath(posixpath.normpath(r["b"]).replace("//", "/"),
                                   posixpath.normpath(r["a"]).replace("//", "/"))
        assert (r["r"] or ".") == wanted, (r["a"], r["b"])


def test_join(spark):
    df = spark.range(1)
    cases = {("a", "../b"): "b", ("", "./x"): "x", ("/r", "../../x"): "/x", ("a", ".."): ".",
             ("a/b", "../../.."): "..", ("a//b", "c/"): "a/b/c/"}
    for (left, right), wanted in cases.items():
        assert df.select(paths.join_paths(F.lit(left), F.lit(right))).first()[0] == wanted


def test_text_functions(spark):
    assert values(spark, text.slugify, ["  Hello, World! ", "x" * 59 + " yz", "--", "É1"]) == [
        "hello-world", "x" * 59 + "-", "", "1"]
    assert values(spark, text.clean_title, ["\n a\nb \t", " \n", None]) == [
        "a b", "Code File", "Code File"]
    assert values(spark, text.review_body, ["x\n## History\n- 1", "x \n"]) == ["x", "x"]
    assert values(spark, text.review_history, ["x\n## History\n- 1\n", "x"]) == [
        "## History\n- 1", "## History\n"]
    df = spark.range(1)
    linked = text.annotate_links(F.array(*[F.lit(s) for s in
                                          ("./a", "/b", "C:/d", "c:\\e", "fs", "@s/p", "..")]))
    assert df.select(linked).first()[0] == [
        "./a", "/b", "C:/d", "c:\\e", "fs (library)", "@s/p (library)", ".."]


def test_numbered_sections(spark):
    body = "1. A\n first \n2. B\nsecond with 2. inside\n3. C\nthird\n4. D\nfourth\nmore\n"
    df = spark.createDataFrame([(body,), ("no numbers",)], "t string")
    parts = text.numbered_sections(F.col("t"))
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert rows[0].asDict() == {
        "explanation": "first", "use_case": "second with 2. inside", "abstraction": "third",
        "functions_used": "fourth\nmore", "partial": False}
    assert rows[1].asDict() == {
        "explanation": "", "use_case": "", "abstraction": "", "functions_used": "",
        "partial": True}


def test_needs_full(spark):
    df = spark.createDataFrame(
        [("fine", 500), ("fine", 99), ("it is NOT RELEVANT here", 500), (None, 500)],
        "answer string, chars int")
    got = df.select(text.needs_full_content(F.col("answer"), F.col("chars"))).collect()
    assert [r[0] for r in got] == [False, True, True, None]


@pytest.mark.parametrize("include, exclude, wanted", [
    (None, None, ["src/a.ts", "src/b.js", "lib/a.TS"]),
    ("", "", ["src/a.ts", "src/b.js", "lib/a.TS"]),
    ("src", None, ["src/a.ts", "src/b.js"]),
    ("root", None, []),  # text sees the relative path only
    ({"regexp": "^/root/.*ts$"}, None, ["src/a.ts"]),
    ({"regexp": "TS$", "flags": "gi"}, {"regexp": "^/root/lib"}, ["src/a.ts"]),
    (None, "a.", ["src/b.js"]),
])
def test_path_filters(spark, include, exclude, wanted):
    df = spark.createDataFrame([("src/a.ts",), ("src/b.js",), ("lib/a.TS",)], "path string")
    kept = df.filter(filters.path_kept(F.col("path"), include, exclude, "/root"))
    assert [r[0] for r in kept.collect()] == wanted


def test_extension_filter(spark):
    df = spark.createDataFrame([("a.ts",), ("b.TS",), ("c",)], "path string")

    def count(*args):
        return df.filter(filters.has_extension(F.col("path"), *args)).count()

    assert (count([]), count([".ts"]), count([".ts"], True), count([""])) == (3, 2, 1, 1)

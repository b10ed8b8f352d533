"""Inference stage and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeloom.operators import inference, search
from codeloom.streaming import reviews


def echo_model():
    def answer(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("down")
        assert len(prompts) <= 2
        return [p.upper() for p in prompts]

    return answer


def test_only_bad_rows_fail(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(7)], "i int, p string")
    rows = {r["i"]: r for r in inference.infer(df, "p", echo_model, batch_rows=2).collect()}
    assert rows[3]["response"] is None and rows[3]["model_error"] == "RuntimeError: down"
    assert all(rows[i]["response"] == f"P{i}" and rows[i]["model_error"] is None
               for i in rows if i != 3)


def test_wrong_number_of_answers_is_an_error(spark):
    df = spark.createDataFrame([(1, "p")], "i int, p string")
    row = inference.infer(df, "p", lambda: lambda prompts: []).first()
    assert row["model_error"] == "ValueError: 0 responses to 1 prompts"


def test_validation(spark):
    cases = {
        "ok": {"answer": "a", "neededFiles": ["x"], "searchForUsage": {"regex": "r", "fileTypes": [".ts"]}},
        "defaults": {"answer": "", "neededFiles": []},
        "error": {"answer": "a", "neededFiles": [], "error": "failed"},
        "no answer": {"neededFiles": []},
        "no files": {"answer": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("cut", '{"answer": "a'), ("null", None)]
    df = spark.createDataFrame(rows, "path string, response string")
    got = {r["path"]: r for r in inference.parse_answers(df).collect()}
    assert got["ok"]["search"]["regex"] == "r" and got["ok"]["error"] is None
    assert (got["defaults"]["answer"], got["defaults"]["needed_files"], got["defaults"]["search"]) == (
        "", [], None)
    assert got["error"]["error"] == "failed" and got["error"]["answer"] == "a"
    for path in ("no answer", "no files", "cut", "null"):
        assert got[path]["error"] == inference.INVALID, path
        assert got[path]["answer"] is None and got[path]["needed_files"] == []


def counted_calls():
    """Not relevant unless the content is full; the length of the prompt is the answer."""
    def answer(prompts):
        return [json.dumps({"answer": "full" if "FULL" in p else "Not relevant.", "neededFiles": []})
                for p in prompts]

    return answer


def test_one_retry_with_full_content(spark):
    files = spark.createDataFrame(
        [("a", None, "s" * 200, "FULL text"), ("b", "a", "FULL " + "s" * 200, "other"),
         ("c", "a", "s" * 200, "nothing more")],
        "path string, parent string, summary string, content string")
    got = {r["path"]: (r["answer"], r["used_full"])
           for r in inference.answer_files(files, "q?", counted_calls).collect()}
    assert got == {"a": ("full", True), "b": ("full", False), "c": ("Not relevant.", True)}


def test_routing(spark):
    answers = spark.createDataFrame(
        [("a", ["x", "y"], None), ("b", ["z"], "failed")],
        "path string, needed_files array<string>, error string")
    good, problems = inference.route_errors(answers)
    assert [tuple(r) for r in problems.collect()] == [("b", "Error in file b: failed")]
    hits = spark.createDataFrame([("a", "y"), ("a", "w")], "parent string, path string")
    needed = inference.needed_paths(good, hits).orderBy("pos").collect()
    assert [(r["parent"], r["path"]) for r in needed] == [("a", "x"), ("a", "y"), ("a", "w")]


def test_usage_searches_of_answers(spark):
    answers = spark.createDataFrame(
        [("a", (r"\btotal\b", None, [".ts"])), ("b", (r"\btotal\b", "", [".TS"])),
         ("c", ("TOT.l", "i", [])), ("d", ("(", None, [".ts"])), ("e", None),
         ("f", ("total", "", [".js"]))],
        "path string, search struct<regex:string,flags:string,fileTypes:array<string>>")
    files = spark.createDataFrame(
        [("x.ts", "total(1)"), ("y.ts", "subtotal"), ("z.js", "subtotal")],
        "path string, content string")
    for per_scan in (1, 100):
        hits, invalid = search.usage_hits(inference.searches_of(answers), files, per_scan)
        assert sorted(tuple(r) for r in hits.collect()) == [
            ("a", "x.ts"), ("b", "x.ts"), ("c", "x.ts"), ("c", "y.ts"), ("c", "z.js"), ("f", "z.js")]
        assert [tuple(r) for r in invalid.collect()] == [("d", "(")]


UPDATES = "section_key string, body string, updated_at timestamp, reason string"


def _write_updates(spark, folder, rows, n):
    df = spark.createDataFrame(rows, "k string, b string, t string, r string").select(
        F.col("k").alias("section_key"), F.col("b").alias("body"),
        F.col("t").cast("timestamp").alias("updated_at"), F.col("r").alias("reason"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in{n}")


def _stream(spark, folder):
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")


def test_review_over_several_batches_and_restarts(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("src", "review", "checkpoint"))
    batches = [
        [("s1", "long one", "2024-01-01", "r"), ("s2", "x", "2024-01-01", "r")],
        [("s1", "short", "2024-01-02", "r"), ("s2", "y", "2024-01-02", "r")],
    ]
    for n, rows in enumerate(batches):
        _write_updates(spark, folder, rows, n)
    reviews.maintain_review(_stream(spark, folder), target, checkpoint).awaitTermination()
    _write_updates(spark, folder, [("s3", "new", "2024-01-03", "r")], 2)
    for _ in range(2):  # the second start finds nothing new
        reviews.maintain_review(_stream(spark, folder), target, checkpoint).awaitTermination()
    got = {r["section_key"]: r["body"] for r in reviews.read_review(spark, target).collect()}
    assert got == {"s1": "long one", "s2": "y", "s3": "new"}
    assert reviews.read_history(spark, target).count() == 5
    assert reviews.read_history(spark, target).select("batch_id").distinct().count() == 3


def test_repeated_batch_counts_once(spark, tmp_path):
    """Losing the progress of a stream repeats its batches; the result stays the same."""
    folder, target = str(tmp_path / "src"), str(tmp_path / "review")
    _write_updates(spark, folder, [("s1", "a", "2024-01-01", "r")], 0)
    for attempt in range(2):
        reviews.maintain_review(
            _stream(spark, folder), target, str(tmp_path / f"c{attempt}")).awaitTermination()
    assert reviews.read_history(spark, target).count() == 1
    assert reviews.read_review(spark, target).count() == 1


def test_work_dedup(spark, tmp_path):
    schema = "path string, aspect string, at timestamp"
    rows = [("a", "summary", "2024-01-01"), ("a", "full", "2024-01-01"), ("a", "summary", "2024-01-01")]
    for n in range(2):
        spark.createDataFrame(rows, "path string, aspect string, at string").withColumn(
            "at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
    for name, within in (("plain", None), ("bounded", "1 day")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
            str(tmp_path / "w*"))
        work = reviews.first_seen_work(stream, "at", within)
        reviews.append_work(
            work, str(tmp_path / name), str(tmp_path / f"c-{name}")).awaitTermination()
        got = spark.read.schema(schema).parquet(str(tmp_path / name)).collect()
        assert sorted((r["path"], r["aspect"]) for r in got) == [("a", "full"), ("a", "summary")]


def test_answers_of_wrong_types_are_invalid(spark):
    good = '{"answer": "a", "neededFiles": ["x"], "error": null, "searchForUsage": null}'
    rows = [
        good, '{"answer": "", "neededFiles": []}',
        '{"answer": "a", "neededFiles": [], "searchForUsage": {"regex": "r", "fileTypes": [".a"]}}',
        '{"answer": 5, "neededFiles": []}', '{"answer": {"b": 1}, "neededFiles": []}',
        '{"answer": "a", "neededFiles": [1]}', '{"answer": "a", "neededFiles": ["x", null]}',
        '{"answer": "a", "neededFiles": [null]}', '{"answer": "a", "neededFiles": "x"}',
        '{"answer": "a", "neededFiles": [], "error": 3}',
        '{"answer": "a", "neededFiles": [], "searchForUsage": {"regex": 1, "fileTypes": []}}',
        '{"answer": "a", "neededFiles": [], "searchForUsage": {"regex": "r"}}', "no json", None,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, response string")
    got = inference.parse_answers(df).orderBy("i").collect()
    assert [r["i"] for r in got if r["error"] is None] == [0, 1, 2]
    assert all(r["answer"] is None and r["needed_files"] == [] for r in got[3:])

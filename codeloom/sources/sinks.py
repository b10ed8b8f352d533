"""Notes, reports and reviews written below a run folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import fixed_values as V
from codeloom.functions.text import history_entry, strip
from codeloom.operators.dedup import keep_best
from codeloom.session import cut_lineage


def _notes(rows: DataFrame, run_id: str) -> DataFrame:
    body = F.coalesce(F.nullif(strip(F.col("body")), F.lit("")), F.lit(V.EMPTY_NOTE))
    return rows.select(F.lit(run_id).alias("run_id"), "path", body.alias("note"))


def write_notes(rows: DataFrame, target: str, run_id: str) -> None:
    """One note per file (path, body), keyed by its full path. Only the folder of this run
    is replaced, so a repeated run does not add rows."""
    _notes(rows, run_id).drop("run_id").write.mode("overwrite").parquet(
        f"{target}/run_id={run_id}"
    )


def read_notes(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("path string, note string, run_id string").parquet(target)


def write_report(lines: DataFrame, target: str, run_id: str) -> None:
    """Text lines per report (report, section, seq, kind, pos, line) as ordered text files:
    the files of a report, in name order, are its text. Nothing is brought to one task."""
    # the sort reads its input twice, once to find the ranges
    (
        cut_lineage(lines).orderBy("report", "section", "seq", "kind", "pos")
        .select("report", "line")
        .write.mode("overwrite").partitionBy("report")
        .text(f"{target}/run_id={run_id}")
    )


def write_rendered_review(lines: DataFrame, target: str, version: str) -> None:
    """Review lines (section, key, at, line) as ordered text files of one version."""
    (
        cut_lineage(lines).orderBy("section", "key", "at", "line").select("line")
        .write.mode("overwrite").text(f"{target}/text/version={version}")
    )


def merge_review(sections: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Sections (section_key, body, updated_at) after the updates: per key the most
    complete body, the latest of these."""
    columns = ["section_key", "body", "updated_at"]
    fresh = updates.select(*columns)
    both = fresh if sections is None else sections.select(*columns).unionByName(fresh)
    return keep_best(both, ["section_key"], [F.length("body"), "updated_at"])


def history_lines(updates: DataFrame) -> DataFrame:
    return updates.select(
        "updated_at", history_entry(F.col("updated_at"), F.col("reason")).alias("entry")
    )


def write_review(
    spark: SparkSession, target: str, previous: str | None, version: str, updates: DataFrame
) -> DataFrame:
    """Fold updates (section_key, body, updated_at, reason) into the review of ``previous``
    and write it as ``version``; history grows by one folder per version."""
    columns = "section_key string, body string, updated_at timestamp"
    old = spark.read.schema(columns).parquet(f"{target}/sections/version={previous}") \
        if previous else None
    merge_review(old, updates).write.mode("overwrite").parquet(
        f"{target}/sections/version={version}")
    history_lines(updates).write.mode("overwrite").parquet(
        f"{target}/history/version={version}")
    return spark.read.schema(columns).parquet(f"{target}/sections/version={version}")

"""Streams that run to the end of their input and what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.session import scratch_path
from codeloom.streaming import reviews


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENTS).parquet(f"{sf_dir}/events*.parquet")


def t1_incremental_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "stream-review")
    query = reviews.maintain_review(
        reviews.as_updates(_event_stream(spark, sf_dir)), target, scratch_path(spark, "stream"))
    query.awaitTermination()
    sections = reviews.read_review(spark, target).select(
        F.lit("section").alias("kind"), F.col("section_key").alias("key"), "body")
    history = reviews.read_history(spark, target).groupBy(
        F.regexp_extract("entry", r": (\w+)$", 1).alias("key")
    ).agg(F.count("*").cast("string").alias("body"))
    return sections.unionByName(
        history.select(F.lit("history").alias("kind"), "key", "body"))


def t2_work_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _event_stream(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("aspect"))
    target = scratch_path(spark, "work")
    query = reviews.append_work(
        reviews.first_seen_work(work), target, scratch_path(spark, "stream"))
    query.awaitTermination()
    return spark.read.schema("path string, aspect string").parquet(target)


QUERIES = {f.__name__: f for f in (t1_incremental_review, t2_work_dedup)}

ORACLES = {
    "t1_incremental_review": """
SELECT 'section' AS kind, user_id::VARCHAR AS key,
       arg_max(props, (length(props), ts, props)) AS body FROM events GROUP BY user_id
UNION ALL
SELECT 'history', event_type, count(*)::VARCHAR FROM events GROUP BY event_type""",
    "t2_work_dedup": "SELECT DISTINCT 'u' || user_id AS path, event_type AS aspect FROM events",
}

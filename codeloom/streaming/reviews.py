"""Incremental forms: review upkeep and work dedup on streams."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.sources.sinks import history_lines, merge_review

_SECTIONS = "section_key string, body string, updated_at timestamp, batch_id long"
_HISTORY = "updated_at timestamp, entry string, batch_id long"


def maintain_review(updates: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of updates (section_key, body, updated_at, reason) into a review.

    A batch writes only its own best body per section and its history lines, each into the
    folder of its batch id. A batch that is repeated after a failure replaces its folder, so
    nothing counts twice, and its cost follows the batch, not the review. ``read_review``
    merges the folders.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        # two jobs write from it; what an executor takes with it is read from the source again
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            merge_review(None, batch).write.mode("overwrite").parquet(
                f"{target}/sections/batch_id={batch_id}")
            history_lines(batch).write.mode("overwrite").parquet(
                f"{target}/history/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        updates.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_review(spark: SparkSession, target: str) -> DataFrame:
    """Sections over all batches: best of the batch-wise best ones."""
    stored = spark.read.schema(_SECTIONS).parquet(f"{target}/sections")
    return merge_review(None, stored)


def read_history(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(_HISTORY).parquet(f"{target}/history")


def first_seen_work(work: DataFrame, time: str | None = None, within: str | None = None):
    """Work items by (path, aspect), each once.

    Without ``within`` the keys seen so far are kept for good, as the work list needs it;
    with it a key is only remembered that long in event time, which bounds the state.
    """
    keys = ["path", "aspect"]
    if within is None:
        return work.dropDuplicates(keys)
    return work.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def append_work(work: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of work items as files, for the batch jobs to pick up."""
    return (
        work.writeStream.format("parquet").outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def as_updates(events: DataFrame) -> DataFrame:
    """Events as review updates: one section per user, newest payload first."""
    return events.select(
        F.col("user_id").cast("string").alias("section_key"),
        F.col("props").alias("body"),
        F.col("ts").alias("updated_at"),
        F.col("event_type").alias("reason"),
    )

"""Session settings, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder would be lost with the machine, so the job stops instead.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="codeloom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint and go on from the files.

    Used where a result is read by several later jobs (levels of a traversal, answers of a
    model): a lost executor then costs a re-read, not a re-run.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, as ``cut_lineage`` does, but
    with columns that later steps can read alone."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """As ``stored``, in buckets by ``key``: later joins and groups by it do not shuffle the rows
    again. The table has its name only until it is open; the files are all that stays."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    write_by(df, key, path, partitions)
    return read_by(spark, path, df.schema, key, partitions)


def write_by(df: DataFrame, key: str, path: str, partitions: int) -> None:
    """Write ``df`` in ``partitions`` buckets by ``key`` to ``path``."""
    name = f"written_{uuid.uuid4().hex}"
    df.repartition(partitions, key).write.format("parquet").mode("overwrite").bucketBy(
        partitions, key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_by(
    spark: SparkSession, path: str, schema: StructType, key: str, partitions: int
) -> DataFrame:
    """What ``write_by`` has written, in its buckets."""
    name = f"read_{uuid.uuid4().hex}"
    at = path.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet "
              f"CLUSTERED BY (`{key}`) INTO {partitions} BUCKETS LOCATION '{at}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found

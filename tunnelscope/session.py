"""Shared storage, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension at or under this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    A session without that setting gets a folder of its own in the default file system. That must be a shared one, but for
    local mode. ``clear_shared_dir`` removes it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    context = spark.sparkContext
    system = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    one_machine = context.master == "local" or context.master.startswith("local[")
    if system.startswith("file:") and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(f"{system.rstrip('/')}/tmp/tunnelscope-{context.applicationId}")
    return context.getCheckpointDir().rstrip("/")


def clear_shared_dir(spark: SparkSession) -> None:
    """Removes the folder that ``shared_dir`` made; tables read from it can't be used after that. A configured folder stays."""
    made = spark.sparkContext.getCheckpointDir()
    if made and not spark.conf.get("spark.checkpoint.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Several later branches then scan only the columns they need, and a lost executor costs a
    re-read, not a recomputation of the packets. Whole texts take less disk with the ``codec`` zstd.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``dim`` if it really has at most ``max_rows`` rows, else leave the join to Spark."""
    if dim.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(dim)
    return dim

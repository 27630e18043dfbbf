"""What a micro-batch hands to the next one: short tables in a state folder, one version per batch.

A batch that is run again reads the version of the batch before it and overwrites its own, so it writes the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tails:
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def read(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        """The table that the batch before ``batch_id`` left."""
        if batch_id == 0:
            return None
        return spark.read.parquet(f"{self.folder}/{name}/{batch_id - 1}")

    def write(self, table: DataFrame, name: str, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch_id}")

    def write_last(self, table: DataFrame, name: str, keys: list[str], rows: int, batch_id: int) -> None:
        """Keep the last ``rows`` windows of each key."""
        latest = Window.partitionBy(*keys).orderBy(F.desc("window"))
        tail = table.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= rows)
        self.write(tail.drop("_age"), name, batch_id)

    def joined(self, name: str, fresh: DataFrame, batch_id: int) -> DataFrame:
        """Tail and new rows, marked; the mark survives in ``_new``."""
        marked = fresh.withColumn("_new", F.lit(True))
        tail = self.read(fresh.sparkSession, name, batch_id)
        if tail is None:
            return marked
        return marked.unionByName(tail.withColumn("_new", F.lit(False)), allowMissingColumns=True)

    def last_batch(self, spark: SparkSession, name: str) -> int:
        """Number of the last batch that left a table, -1 if none did."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return -1
        # A version counts when its writer has committed it.
        done = [int(s.getPath().getName()) for s in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=-1)

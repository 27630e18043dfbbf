"""Debounced alarms and episodes over micro-batches, by the plans of batch runs.

A batch debounces its rows behind the last known rows of each class, so a class of any length is split as in a batch run and only a few
rows per class are handed on. Episodes that are open at the end of a batch are carried as one row per class. ``EpisodeStream.episodes`` closes what is open at the
last processed window, so a run can be read, or end, after any batch. Rows that are not later than the last one of their class are
set aside in a table of their own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.alarms import debounce, episode_runs
from ..schemas import EVENT_SCHEMA
from ..session import cut
from .tails import Tails

OPEN = "qfi int, start_win int, peak_score double, duration bigint"
EPISODE = "qfi int, start_win int, end_win int, peak_score double, duration bigint"


class EpisodeStream:
    """Steps micro-batches of scored rows (window, qfi, score, thr, pred); batches hold later windows than those before."""

    def __init__(self, folder: str, k: int = 1, h: float = 1.0, slice_windows: int = 4096, block_rows: int = 4096) -> None:
        self.folder = folder.rstrip("/")
        self.tails = Tails(f"{self.folder}/state")
        self.k, self.h, self.slice_windows, self.block_rows = k, h, slice_windows, block_rows

    def start(self, scored: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Writer of the stream; start it with the trigger of your choice."""
        return scored.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.select("window", "qfi", "score", "thr", "pred"), "scored")
        before = self.tails.read(spark, "alarms", batch_id)
        if before is not None:
            newest = before.groupBy("qfi").agg(F.max("window").alias("_newest"))
            dated = rows.join(newest, "qfi", "left")
            late = F.col("window") <= F.col("_newest")
            dated.where(late).drop("_newest").write.mode("overwrite").json(f"{self.folder}/late/batch={batch_id}")
            rows = dated.where(F.coalesce(~late, F.lit(True))).drop("_newest")
        series = cut(self.tails.joined("alarms", rows, batch_id), "series")
        known = None
        if "debounced" in series.columns:
            series, known = series.withColumnRenamed("debounced", "_known"), "_known"
        alarms = debounce(series, self.k, self.h, self.slice_windows, self.block_rows, known=known)
        events = cut(alarms.select(*EVENT_SCHEMA.fieldNames(), "_new"), "events")
        fresh = events.where("_new").drop("_new")
        self._step_episodes(spark, fresh, batch_id)
        fresh.write.mode("overwrite").json(f"{self.folder}/events/batch={batch_id}")
        # Written last: its version tells that the batch is done.
        self.tails.write_last(events.drop("_new"), "alarms", ["qfi"], max(self.k, 1), batch_id)

    def _step_episodes(self, spark: SparkSession, events: DataFrame, batch_id: int) -> None:
        carried = self.tails.read(spark, "open", batch_id)
        if carried is None:
            carried = spark.createDataFrame([], OPEN)
        runs = episode_runs(events, self.slice_windows)
        # The rows up to the first that is off go on with what is open.
        held = carried.select("qfi", *[F.col(c).alias(f"_{c}") for c in ("start_win", "peak_score", "duration")], F.lit(0).cast("bigint").alias("_episode"))
        both = runs.join(held, ["qfi", "_episode"], "full").select(
            "qfi",
            F.coalesce("_start_win", "start_win").alias("start_win"),
            "_off",
            F.greatest("peak_score", "_peak_score").alias("peak_score"),
            (F.coalesce("duration", F.lit(0)) + F.coalesce("_duration", F.lit(0))).alias("duration"),
        )
        found = cut(both.where("duration > 0"), "runs")
        closed = found.where("_off IS NOT NULL").select("qfi", "start_win", (F.col("_off") - 1).cast("int").alias("end_win"), "peak_score", "duration")
        closed.write.mode("overwrite").json(f"{self.folder}/episodes/batch={batch_id}")
        self.tails.write(found.where("_off IS NULL").drop("_off"), "open", batch_id)

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        try:
            return spark.read.schema(schema).json(f"{self.folder}/{name}/batch=*")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    def events(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "events", EVENT_SCHEMA)

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows set aside."""
        return self._read(spark, "late", "window int, qfi int, score double, thr double, pred int")

    def episodes(self, spark: SparkSession) -> DataFrame:
        """Episodes so far; those that are open end at the last processed window."""
        closed = self._read(spark, "episodes", EPISODE)
        last = self.tails.last_batch(spark, "alarms")
        if last < 0:
            return closed
        newest = self.tails.read(spark, "alarms", last + 1).select(F.max("window")).scalar()
        still = self.tails.read(spark, "open", last + 1)
        return closed.unionByName(still.withColumn("end_win", newest.cast("int")).select(*closed.columns))

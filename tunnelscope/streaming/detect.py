"""The whole detection run on a stream of sketch snapshots.

Each micro-batch goes through the batch plans. What a row needs of earlier batches is a short tail
per series: five rows per tunnel, 30 per class with the averages so far, and the last alarm rows. The tails are tables in
the state folder, one version per batch, so a batch that is run again reads the same tails and
writes the same result.

``read_sketch_stream`` gives rows of files in the order of their modification times and fails on a late window;
``windowstream.read_window_stream`` gives files in the order of their window numbers (``start_files``), and late windows stay out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import THRESHOLD_LOOKBACK, BinEdges, PipelineConfig
from ..operators.alarms import debounce
from ..operators.classes import aggregate_classes
from ..operators.minquery import clean_sketch, min_query
from ..operators.rolling import HISTORY_ROWS, averages_of, engineer
from ..operators.scoring import decide, score
from ..operators.tunnels import tunnel_features, tunnel_windows
from ..schemas import EVENT_SCHEMA, sketch_schema
from ..session import cut
from ..sources.windows import FILE_PATH, last_copy, paired, read_files, read_flow_keys
from ..functions.fields import window_number
from .tails import Tails


def read_sketch_stream(
    spark: SparkSession, folder: str, config: PipelineConfig, files_per_batch: int = 60
) -> DataFrame:
    """Snapshots as they arrive in a folder."""
    raw = (
        spark.readStream.schema(sketch_schema(config.geometry))
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return raw.withColumn("window", window_number(F.col(FILE_PATH)))


class DetectionStream:
    """Steps micro-batches of snapshots into events."""

    def __init__(
        self,
        keys_folder: str,
        state_folder: str,
        events_folder: str,
        edges: BinEdges,
        feat_cols: list[str],
        model: dict,
        config: PipelineConfig,
    ) -> None:
        self.keys_folder = keys_folder
        self.tails = Tails(state_folder)
        self.events_folder = events_folder.rstrip("/")
        self.edges = edges
        self.feat_cols = feat_cols
        self.model = model
        self.config = config

    def start(self, snapshots: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Writer of the stream; start it with the trigger of your choice."""
        return snapshots.writeStream.foreachBatch(self.step).option(
            "checkpointLocation", checkpoint
        )

    def start_files(self, files: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Writer of a stream of files (window, path), which are read as in a batch run: columns of any type, files that differ."""
        return files.writeStream.foreachBatch(self.step_files).option("checkpointLocation", checkpoint)

    def step_files(self, batch: DataFrame, batch_id: int) -> None:
        # The files of the windows of one batch.
        paths = [r.path for r in batch.select("path").collect()]
        if paths:
            snapshots = read_files(batch.sparkSession, paths, self.config.geometry)
            self._step(last_copy(snapshots, "position"), batch_id)

    def processed(self, spark: SparkSession) -> DataFrame:
        """Windows processed so far, for a run that was stopped too: (window, classes)."""
        events = read_stream_events(spark, self.events_folder)
        return events.groupBy("window").agg(F.collect_set("qfi").alias("classes"))

    def _new_windows(self, table: DataFrame, fresh: DataFrame) -> DataFrame:
        return table.join(fresh.select("window").distinct(), "window", "left_semi")

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Process one micro-batch. Its windows must be later than those of earlier batches."""
        self._step(clean_sketch(batch, self.config.geometry), batch_id)

    def _step(self, cells: DataFrame, batch_id: int) -> None:
        spark, config = cells.sparkSession, self.config
        sketch = cut(cells, "sketch")
        self._reject_late(sketch, batch_id)
        keys = read_flow_keys(spark, self.keys_folder)
        flows = min_query(sketch, paired(keys, sketch), config.geometry, config.slice_windows)

        fresh = cut(tunnel_windows(flows, self.edges, config), "tunnels")
        tunnels = cut(self.tails.joined("tunnels", fresh, batch_id), "tunnels").drop("_new")
        self.tails.write_last(tunnels, "tunnels", ["qfi", "teid"], THRESHOLD_LOOKBACK, batch_id)
        features = cut(self._new_windows(tunnel_features(tunnels, config), fresh), "features")

        fresh_classes = aggregate_classes(features, config.feature_decimals)
        classes = cut(self.tails.joined("classes", fresh_classes, batch_id), "classes").drop("_new")
        known = "_averages" if "_averages" in classes.columns else None
        engineered = cut(self._new_windows(engineer(classes, config, known=known), fresh), "engineered")
        base = [c for c in classes.columns if c != "_averages"]
        kept = engineered.select(*base, averages_of(engineered).alias("_averages"))
        if known:
            kept = kept.unionByName(classes.where("_averages IS NOT NULL"))
        self.tails.write_last(kept, "classes", ["qfi"], HISTORY_ROWS, batch_id)

        scored = decide(score(engineered, self.feat_cols, self.model), config)
        narrow = scored.select("window", "qfi", "score", "thr", "pred")
        series = cut(self.tails.joined("alarms", narrow, batch_id), "scored")
        if "debounced" in series.columns:
            series = series.withColumnRenamed("debounced", "_known")
        known = "_known" if "_known" in series.columns else None
        alarms = debounce(
            series,
            config.debounce_k,
            config.debounce_h,
            config.slice_windows,
            config.block_rows,
            known=known,
        )
        events = cut(alarms.select(*EVENT_SCHEMA.fieldNames(), "_new"), "events")
        own_tail = events.drop("_new")
        self.tails.write_last(own_tail, "alarms", ["qfi"], max(config.debounce_k, 1), batch_id)
        events.where("_new").drop("_new").write.mode("overwrite").json(
            f"{self.events_folder}/batch={batch_id}"
        )

    def _reject_late(self, sketch: DataFrame, batch_id: int) -> None:
        """A window at or before one already stepped cannot be inserted into the series."""
        tail = self.tails.read(sketch.sparkSession, "classes", batch_id)
        if tail is None:
            return
        newest = tail.select(F.max("window")).scalar()
        late = sketch.where(F.col("window") <= newest).select("window").distinct()
        found = [r.window for r in late.limit(20).toLocalIterator()]
        if found:
            raise ValueError(f"windows {found} arrive after later ones were processed")


def read_stream_events(spark: SparkSession, events_folder: str) -> DataFrame:
    """Events of all batches."""
    try:
        return spark.read.schema(EVENT_SCHEMA).json(f"{events_folder}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], EVENT_SCHEMA)

"""Ground truth: injector logs and the episode labels made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INJECTION_SCHEMA

START_EVENTS = ["start", "teid_impersonation"]
STOP_EVENTS = ["stop", "teid_impersonation_end"]


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON objects in a log; text lines, broken JSON and lists are skipped."""
    text = F.trim(F.col(line))
    objects = lines.where(text.rlike(r"^\{"))
    # A generator parses each line once; as a column, every field read from it would parse it again.
    parsed = F.inline(F.array(F.from_json(text, INJECTION_SCHEMA)))
    return objects.select("*", parsed).where(F.col("event").isNotNull()).drop(line)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files; ``source`` and ``line_no`` keep the order of the lines of a file."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source"),
        # Files are split into blocks in order; the id grows within a block.
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )
    return parse_log(raw)


def _last(value: Column, when: Column) -> Column:
    """Value of the last log row for which ``when`` holds."""
    position = F.when(when, F.struct("block", "line_no"))
    return F.max_by(value, position)


def label_episodes(
    log: DataFrame, anomaly_type: str, episode: list[str], offset_ms: int = 0, params: list[str] | None = None
) -> DataFrame:
    """One label per injected episode: its interval, classes and tunnels.

    ``episode`` names the columns that identify one injector run (its episode id, or the source
    file where the log has none). The last start and the last stop of a run count. A missing
    stop becomes start + ``duration_s`` if the log has that column. A run whose log names no class has the one
    asked for, ``requested_qfi``, if the log has that column. Runs without a start have no label.

    Rules of impersonation runs (``policy_abuse``) alone: without tunnels or with an exit code ``rc`` other than 0 they
    have no label, and a stop that is not later than the start counts as missing.

    ``params`` names columns of the log (one value per run) that go, with the victims, into a JSON column ``params``.
    """
    is_start = F.col("event").isin(START_EVENTS)
    is_stop = F.col("event").isin(STOP_EVENTS)
    victims = F.filter("victims", lambda v: F.coalesce(v["teid"], F.lit("")) != "")
    teids = F.coalesce(
        F.filter("actors.teids", lambda t: F.coalesce(t, F.lit("")) != ""),
        F.transform(victims, lambda v: v["teid"]),
    )
    victim_classes = F.array_compact(F.transform("victims", lambda v: v["victim_qfi"]))
    qfis = F.when(F.col("actors.qfi").isNotNull(), F.array("actors.qfi")).otherwise(
        F.array_sort(F.array_distinct(victim_classes))
    )
    impersonation = anomaly_type == "policy_abuse"
    known = [c for c in ("duration_s", "rc", "requested_qfi") if c in log.columns]
    extras = {c: F.max(c).alias(f"_{c}") for c in dict.fromkeys([*known, *(params or [])])}
    runs = log.groupBy(*episode).agg(
        _last(F.struct("ts_ns", teids.alias("teids"), qfis.alias("qfis"), "victims"), is_start).alias("_first"),
        _last(F.col("ts_ns"), is_stop).alias("_stop"),
        *extras.values(),
    )
    runs = runs.select("*", F.col("_first.ts_ns").alias("_start"), "_first.teids", "_first.qfis", "_first.victims")
    if "requested_qfi" in extras:
        named = F.size(F.coalesce("qfis", F.array())) > 0
        runs = runs.withColumn("qfis", F.when(named, F.col("qfis")).otherwise(F.array(F.col("_requested_qfi").cast("int"))))
    stop = F.col("_stop")
    if "duration_s" in extras:
        there = stop > F.col("_start") if impersonation else stop.isNotNull()
        planned = F.col("_start") + F.col("_duration_s").cast("bigint") * 1_000_000_000
        stop = F.when(F.coalesce(there, F.lit(False)), stop).otherwise(planned)
    kept = runs.where(F.col("_start").isNotNull())
    if impersonation:
        kept = kept.where(F.size(F.coalesce("teids", F.array())) > 0)
        if "rc" in extras:
            kept = kept.where(F.coalesce("_rc", F.lit(0)) == 0)
    own = [F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in params], "victims")).alias("params")] if params else []
    offset = F.lit(offset_ms * 1_000_000).cast("bigint")
    return kept.select(
        F.lit(anomaly_type).alias("anomaly_type"),
        *episode,
        (F.col("_start") + offset).alias("start_ns"),
        (stop + offset).alias("end_ns"),
        "qfis",
        "teids",
        *own,
    )


def write_labels(labels: DataFrame, folder: str) -> None:
    """Labels as Parquet, lists kept."""
    labels.write.parquet(folder)


def write_labels_csv(labels: DataFrame, folder: str) -> None:
    """Labels as CSV, lists as JSON text."""
    lists = {c: F.to_json(c) for c in ("qfis", "teids")}
    labels.withColumns(lists).write.option("header", True).option("escape", '"').csv(folder)

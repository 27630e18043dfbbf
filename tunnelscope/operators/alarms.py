"""Debounced alarms and anomaly episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.slices import history_blocks, latest_value, previous_value, running_total


def _slice(slice_windows: int) -> Column:
    return F.floor(F.col("window") / slice_windows)


def debounce(
    scored: DataFrame,
    k: int = 1,
    h: float = 1.0,
    slice_windows: int = 4096,
    block_rows: int = 4096,
    keys: list[str] | None = None,
    known: str | None = None,
) -> DataFrame:
    """Add ``debounced``: on after ``k`` positive rows in a row, off when score < thr * h.

    Each row either sets the alarm, resets it, or leaves it, so the state is the latest set or
    reset. Only with h > 1 can one row do both, depending on the state: it then inverts it, and the
    state is the latest set or reset, inverted as often as such rows followed it.

    ``known`` names a column with the state of rows that were debounced in an earlier run; the
    series goes on from there.
    """
    if k < 1:
        raise ValueError("debounce needs k >= 1")
    keys = keys or ["qfi"]
    blocks = history_blocks(scored, keys, "window", _slice(slice_windows), block_rows, k - 1)
    last_k = Window.partitionBy(*keys, "_block").orderBy("window").rowsBetween(1 - k, 0)
    ready = F.sum("pred").over(last_k) >= k
    flagged = (
        blocks.withColumn("_set", ready)
        .where(~F.col("_history"))
        .withColumn("_reset", F.col("score") < F.col("thr") * h)
        .drop("_history")
    )
    given = F.col(known) if known else F.lit(None).cast("int")
    if h <= 1:
        event = F.coalesce(given, F.when(F.col("_set"), 1).when(F.col("_reset"), 0))
        state = latest_value(flagged, keys, ["window"], F.col("_block"), event, "debounced")
    else:
        flip = F.col("_set") & F.col("_reset") & given.isNull()
        counted = running_total(
            flagged, keys, ["window"], F.col("_block"), F.when(flip, 1).otherwise(0), "_flips"
        )
        parity = F.col("_flips") % 2
        decided = F.coalesce(given, F.when(F.col("_set"), 1).when(F.col("_reset"), 0))
        event = F.when(~flip, (decided + parity) % 2)
        state = latest_value(
            counted, keys, ["window"], F.col("_block"), event, "_base"
        ).withColumn("debounced", (F.coalesce("_base", F.lit(0)) + parity) % 2)
    return state.withColumn("debounced", F.coalesce("debounced", F.lit(0)).cast("int")).drop(
        "_block", "_set", "_reset", "_flips", "_base"
    )


def episode_runs(events: DataFrame, slice_windows: int = 4096, run: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each class between rows that are off: (qfi, _episode, start_win, _off, peak_score, duration).

    A row belongs to the run numbered by the off rows before it, which also places the closing row (``_off``) there. A run may have no row that is on.
    """
    off = F.when(F.col("debounced") == 0, 1).otherwise(0)
    numbered = running_total(
        events, [*run, "qfi"], ["window"], _slice(slice_windows), off, "_episode", before=True
    )
    on = F.col("debounced") == 1
    return numbered.groupBy(*run, "qfi", "_episode").agg(
        F.min(F.when(on, F.col("window"))).alias("start_win"),
        F.min(F.when(~on, F.col("window"))).alias("_off"),
        F.max(F.when(on, F.col("score"))).alias("peak_score"),
        F.count_if(on).cast("bigint").alias("duration"),
    )


def episodes(events: DataFrame, slice_windows: int = 4096, run: tuple[str, ...] = ()) -> DataFrame:
    """Runs of debounced rows per class.

    An episode ends one window before the first row that is off again, even if that window was not
    observed; one that is still on ends at the last window of the whole table, or of its run.
    """
    found = episode_runs(events, slice_windows, run).where(F.col("duration") > 0)
    if run:
        # One row per device or recording.
        found = found.join(events.groupBy(*run).agg(F.max("window").alias("_last")), [*run])
        last_window = F.col("_last")
    else:
        last_window = events.select(F.max("window")).scalar()
    return (
        found
        .select(
            *run,
            "qfi",
            "start_win",
            F.coalesce(F.col("_off") - 1, last_window).cast("int").alias("end_win"),
            "peak_score",
            "duration",
        )
    )


def ordered_episodes(found: DataFrame) -> DataFrame:
    return found.orderBy("start_win", "qfi")


def transitions(events: DataFrame, slice_windows: int = 4096) -> DataFrame:
    """Rows at which an alarm starts or ends."""
    linked = previous_value(
        events, ["qfi"], ["window"], _slice(slice_windows), "debounced", "_before"
    )
    before = F.coalesce("_before", F.lit(0))
    kind = F.when((F.col("debounced") == 1) & (before == 0), "start").when(
        (F.col("debounced") == 0) & (before == 1), "end"
    )
    return linked.withColumn("transition", kind).where(kind.isNotNull()).drop("_before")


def run_summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """Windows processed, classes seen and number of episodes."""
    n_episodes = found.select(F.count(F.lit(1))).scalar()
    return events.agg(
        F.count_distinct("window").alias("windows_processed"),
        F.count_distinct("qfi").alias("qfis_monitored"),
    ).withColumn("episodes", n_episodes)

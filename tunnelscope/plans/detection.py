"""The detection run: sketch snapshots and flow keys in, events out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import BinEdges, PipelineConfig
from ..operators.alarms import debounce
from ..operators.classes import aggregate_classes
from ..operators.minquery import min_query
from ..operators.rolling import engineer
from ..operators.scoring import decide, score
from ..operators.tunnels import tunnel_features, tunnel_windows
from ..schemas import EVENT_SCHEMA
from ..session import cut
from ..sources.windows import last_copy, paired


def tunnel_table(
    sketch: DataFrame, keys: DataFrame, edges: BinEdges, config: PipelineConfig
) -> DataFrame:
    """Tunnel statistics per window, written once because the features read them several times.

    A sketch read from files has the place of each row: of cells that a snapshot holds twice the last counts. Such a sketch
    is written once, as it is read for its windows and for its cells.
    """
    if "position" in sketch.columns:
        sketch = cut(last_copy(sketch, "position", config.run), "cells")
    known = paired(keys, sketch, config.run)
    flows = min_query(sketch, known, config.geometry, config.slice_windows, config.run)
    return cut(tunnel_windows(flows, edges, config), "tunnels")


def feature_table(tunnels: DataFrame, config: PipelineConfig) -> DataFrame:
    """Tunnel features, written once: sums, runner-ups and medians each read a few columns."""
    return cut(tunnel_features(tunnels, config), "features")


def class_table(features: DataFrame, config: PipelineConfig) -> DataFrame:
    """Class features, written once: series are counted before they are cut into blocks."""
    return cut(aggregate_classes(features, config.feature_decimals, config.run), "classes")


def detect(
    sketch: DataFrame,
    keys: DataFrame,
    edges: BinEdges,
    feat_cols: list[str],
    model: dict,
    config: PipelineConfig,
) -> DataFrame:
    """One event per (window, class)."""
    tunnels = tunnel_table(sketch, keys, edges, config)
    classes = class_table(feature_table(tunnels, config), config)
    return events_from_classes(classes, feat_cols, model, config)


def events_from_classes(
    classes: DataFrame, feat_cols: list[str], model: dict, config: PipelineConfig
) -> DataFrame:
    """Engineer, score, decide and debounce. The columns of ``config.run`` come before those of an event."""
    keys = [*config.run, "qfi"]
    scored = decide(score(engineer(classes, config, keys), feat_cols, model), config)
    narrow = cut(scored.select(*config.run, "window", "qfi", "score", "thr", "pred"), "scored")
    alarms = debounce(
        narrow, config.debounce_k, config.debounce_h, config.slice_windows, config.block_rows, keys
    )
    return alarms.select(*config.run, *EVENT_SCHEMA.fieldNames())

"""Per-second statistics of a postcard stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.postcards import stats_per_second


def stream_stats(postcards: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Statistics per second of ``ts``; a second is final once the watermark passed it."""
    return stats_per_second(postcards.withWatermark("ts", lateness))

"""Rates from counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.slices import previous_value


def _bits_per_second(unit: int, decimals: int) -> Column:
    """Bits in ``_bytes`` over ``interval_s``, in ``unit``, cut to ``decimals``. Whole-number division, so no digit is lost."""
    scaled = f"CAST(_bytes AS DECIMAL(20, 0)) * {8 * 10**decimals}"
    return F.expr(f"CAST({scaled} div (CAST(interval_s AS DECIMAL(12, 3)) * {unit}) AS DOUBLE)") / 10**decimals


def counter_rates(samples: DataFrame, keys: list[str], order: list[str], slice_by: Column) -> DataFrame:
    """Rates between consecutive counter samples of an interface.

    Mbit/s and Gbit/s are cut to 2 and 3 decimals; the packet figure is the plain difference. The
    first sample of an interface has no rate. Needs ``bytes, packets, interval_s``.
    """
    both = samples.withColumn("_now", F.struct("bytes", "packets"))
    linked = previous_value(both, keys, order, slice_by, "_now", "_before")
    return (
        linked.where(F.col("_before").isNotNull())
        .withColumn("_bytes", F.col("bytes") - F.col("_before.bytes"))
        .withColumns(
            {
                "mbps": _bits_per_second(1_000_000, 2),
                "gbps": _bits_per_second(1_000_000_000, 3),
                "pkts": F.col("packets") - F.col("_before.packets"),
            }
        )
        .drop("_now", "_before", "_bytes")
    )


def port_totals(packets: DataFrame, port: str) -> DataFrame:
    """Packets and bytes per port."""
    return packets.groupBy(port).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes")
    )

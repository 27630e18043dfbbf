"""Ordered computations per key that do not put a whole key into one task.

A key such as a QoS class, a hash bucket or a busy tunnel may own a large part of all rows. Each
function here splits the key's series into slices (any expression that grows with the order),
works inside the slices, and passes only one small row per (key, slice) along the series. The
results equal those of a window over the whole key.

The input is read twice, so it should be a table scan or a table written with ``session.cut``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _with_carry(df: DataFrame, per_slice: DataFrame, keys: list[str], carry: Column) -> DataFrame:
    """Attach to every row what the slices before its own hand over."""
    series = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*_BEFORE)
    carried = per_slice.select(*keys, "_slice", carry.over(series).alias("_carry"))
    return df.join(carried, [*keys, "_slice"], "left")


def _local(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    value: Column,
    name: str,
    before: bool = False,
) -> DataFrame:
    """Running sum of ``value`` per key; without the row's own value if ``before``."""
    sliced = df.withColumns({"_slice": slice_by, "_value": value.cast("bigint")})
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    frame = _local(keys, order).rowsBetween(*(_BEFORE if before else _SO_FAR))
    inside = F.coalesce(F.sum("_value").over(frame), F.lit(0))
    return (
        _with_carry(sliced, sums, keys, F.sum("_sum"))
        .withColumn(name, F.coalesce("_carry", F.lit(0)) + inside)
        .drop("_slice", "_value", "_carry")
    )


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    value: str,
    name: str,
    last_of_slice: DataFrame | None = None,
) -> DataFrame:
    """``value`` of the row before, null for the first row of a key.

    ``last_of_slice`` (keys, ``_slice``, ``_last``) may come from a cheaper, pre-aggregated source.
    """
    sliced = df.withColumn("_slice", slice_by)
    if last_of_slice is None:
        last_of_slice = sliced.groupBy(*keys, "_slice").agg(
            F.max_by(value, F.struct(*order)).alias("_last")
        )
    return (
        _with_carry(sliced, last_of_slice, keys, F.last("_last"))
        .withColumn(name, F.coalesce(F.lag(value).over(_local(keys, order)), "_carry"))
        .drop("_slice", "_carry")
    )


def latest_value(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, value: Column, name: str
) -> DataFrame:
    """Latest non-null ``value`` up to and including the row."""
    sliced = df.withColumns({"_slice": slice_by, "_value": value})
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    latest = sliced.groupBy(*keys, "_slice").agg(F.max_by("_value", position).alias("_last"))
    inside = F.last("_value", ignorenulls=True).over(_local(keys, order).rowsBetween(*_SO_FAR))
    return (
        _with_carry(sliced, latest, keys, F.last("_last", ignorenulls=True))
        .withColumn(name, F.coalesce(inside, "_carry"))
        .drop("_slice", "_value", "_carry")
    )


def history_blocks(
    df: DataFrame,
    keys: list[str],
    order: str,
    slice_by: Column,
    block_rows: int,
    history: int,
    rank: str | None = None,
) -> DataFrame:
    """Cut each key's series into blocks that carry their own history.

    Adds ``_block`` and ``_history``. Every row is in the block it belongs to, and again, marked
    ``_history``, in each later block whose first row has it among its last ``history`` rows. A
    frame of up to ``history`` preceding rows over (keys, ``_block``) therefore sees the same rows
    as one over the whole key; drop the ``_history`` rows afterwards. ``rank`` names a column with the place
    of a row in its series, from 1, if there is one already; it goes.
    """
    if rank:
        ranked = df.withColumnRenamed(rank, "_rn")
    else:
        ranked = running_total(df, keys, [order], slice_by, F.lit(1), "_rn")
    own = F.floor((F.col("_rn") - 1) / block_rows)
    last = F.floor((F.col("_rn") - 1 + history) / block_rows)
    return (
        ranked.withColumn("_own", own)
        .withColumn("_block", F.explode(F.sequence(own, last)))
        .withColumn("_history", F.col("_block") != F.col("_own"))
        .drop("_rn", "_own")
    )

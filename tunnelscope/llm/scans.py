"""Prefix sums over a table that is range-sorted, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, small_side


def partitions_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_prefix_sums(df: DataFrame, group: str | None, order: list[str], value: str, into: str, whole_rows: bool = False) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows before this one in its ``group``, in ``order``.

    Rows are range-partitioned and sorted by (group, order); each task keeps one running sum, the
    sums of whole partitions are added up in a table of one row per partition and group that
    occurs in it, and are joined back. A hot group spans as many partitions as its rows need. ``order``
    must name columns that make rows distinct, or rows that tie must be alike. ``group`` holds
    no nulls. The result is read from a table in the shared folder, so a lost executor can't change an order. With ``whole_rows``,
    for rows that hold texts, this table is packed tighter, and the sums are broadcast where they are few, so that rows are shuffled once only.
    """
    keys = ([group] if group else []) + order
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(into, T.LongType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, total = None, 0
        for batch in batches:
            values = np.asarray(batch.column(names.index(value)).to_numpy(zero_copy_only=False), dtype=np.int64)
            before = np.cumsum(values) - values
            if group:
                codes = batch.column(names.index(group)).dictionary_encode()
                ids = codes.indices.to_numpy(zero_copy_only=False)
                words = codes.dictionary.to_pylist()
                turns = np.flatnonzero(np.diff(ids, prepend=-1)) if len(ids) else np.zeros(0, np.int64)
                for k, at in enumerate(turns):
                    end = turns[k + 1] if k + 1 < len(turns) else len(ids)
                    if words[ids[at]] != current:
                        current, total = words[ids[at]], 0
                    shift = total - before[at]
                    total += int(values[at:end].sum())
                    before[at:end] += shift
            else:
                before += total
                total += int(values.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(before)], [*names, "_part", into])

    ranged = df.repartitionByRange(partitions_of(df), *keys).sortWithinPartitions(*keys)
    local = cut(ranged.mapInArrow(run, schema), "scan", "zstd" if whole_rows else None)
    # One row per partition and group in it: at most the partitions plus the groups.
    by = ["_part", group] if group else ["_part"]
    sums = local.groupBy(*by).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    joined = local.join(small_side(starts) if whole_rows else starts, by)
    return joined.select(*names, (F.col(into) + F.col("_start")).alias(into))

"""Register dumps: single counters or green/yellow pairs by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _values(columns: list[str]) -> tuple[Column, Column]:
    """Sum and printed form of an entry."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return total, F.concat_ws(";", *[F.col(c).cast("string") for c in columns])


def nonzero(registers: DataFrame, columns: list[str]) -> DataFrame:
    """Entries with any non-zero value, with ``value`` as printed (``a;b`` for a pair) and ``total``."""
    total, text = _values(columns)
    some = F.greatest(*[F.abs(F.col(c)) for c in columns]) if len(columns) > 1 else F.abs(columns[0])
    return registers.where(some != 0).withColumns({"value": text, "total": total})


def top_entries(registers: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` largest entries; equal ones by index."""
    return nonzero(registers, columns).orderBy(F.desc("total"), "index").limit(k)


def write_dump(registers: DataFrame, columns: list[str], folder: str) -> None:
    """Non-zero entries as CSV with the header ``index,value``, largest first."""
    ordered = nonzero(registers, columns).orderBy(F.desc("total"), "index")
    ordered.select("index", "value").write.option("header", True).csv(folder)


def read_dump(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """A dump from ``write_dump``: ``index`` and one column per counter of an entry."""
    text = spark.read.option("header", True).schema("index bigint, value string").csv(folder)
    parts = F.split("value", ";")
    return text.select("index", *[F.get(parts, F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(columns)])

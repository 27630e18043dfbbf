"""Rows told apart by bits, which are broadcast, so that rows with texts need not be shuffled for a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter of keys.
FILTER_BITS = 1 << 23


def bits_of(numbers: DataFrame, number: Column) -> DataFrame:
    """One row (_bucket, _bits) of 4 KB for each 32,768 numbers that has some of ``numbers``: a bit for each."""
    told = numbers.select(number.alias("_h"))
    return told.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))


def looked_up(rows: DataFrame, number: Column, bits: DataFrame) -> DataFrame:
    """``rows`` with ``_held``: whether the bit of their number is set."""
    told = rows.withColumn("_h", number).withColumns({"_bucket": F.bitmap_bucket_number("_h"), "_at": F.bitmap_bit_position("_h").cast("int")})
    byte = F.conv(F.hex(F.expr("substring(_bits, _at DIV 8 + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0, F.lit(False))
    return told.join(bits, "_bucket", "left").select(*rows.columns, held.alias("_held"))


def maybe_among(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``_held``: whether their values of ``by`` may be among those of ``keys``; if not, they are surely not.

    There is one bit per hash class of values, in at most ``FILTER_BITS / 32768`` rows of 4 KB. The more keys there are, the more rows are
    held; an exact join of these must follow.
    """
    place = F.pmod(F.xxhash64(*by), F.lit(FILTER_BITS)) + 1
    return looked_up(rows, place, F.broadcast(bits_of(keys, place)))

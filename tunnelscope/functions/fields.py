"""Unsigned field arithmetic, binary fields and text forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK16 = 0xFFFF
MASK32 = 0xFFFFFFFF
MASK48 = 0xFFFFFFFFFFFF
WINDOW_FILE_PATTERN = r"(?i)(?:^|[/=])window_(\d+)\.(?:csv|parquet)(?:/[^/]*)?$"


def unsigned_be(payload: Column, offset: int | Column, length: int) -> Column:
    """Unsigned big-endian integer of ``length`` bytes at a zero-based offset."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.hex(F.substring(payload, start, F.lit(length))), 16, 10).cast("bigint")


def unsigned_le(payload: Column, offset: int, length: int) -> Column:
    """Unsigned little-endian integer: the same bytes, taken from the last to the first."""
    digits = [F.hex(F.substring(payload, offset + i + 1, 1)) for i in reversed(range(length))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def hex_be(value: Column, length: int) -> Column:
    """Hex text of an unsigned value in ``length`` bytes, big endian."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * length, "0")


def hex_le(value: Column, length: int) -> Column:
    """Hex text of an unsigned value in ``length`` bytes, little endian."""
    text = hex_be(value, length)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(length))])


def switch_tick(tstamp_ns: Column) -> Column:
    """32-bit tick of 1024 ns."""
    return F.shiftright(tstamp_ns, 10).bitwiseAND(F.lit(MASK32))


def latency_q16(hop_latency_ns: Column) -> Column:
    """16-bit latency in ticks; wraps, does not saturate."""
    return F.shiftright(hop_latency_ns, 10).bitwiseAND(F.lit(MASK16))


def iat_q16(now_tick: Column, previous_tick: Column) -> Column:
    """16-bit inter-arrival time in ticks; the difference wraps at 32 bits."""
    return (now_tick - previous_tick).bitwiseAND(F.lit(MASK32)).bitwiseAND(F.lit(MASK16))


def qos_flow_index(teid: Column, qfi: Column) -> Column:
    """16-bit index of a (tunnel, class) pair; tunnel ids from 4096 on alias."""
    high = F.shiftleft(teid.cast("bigint"), 4).bitwiseAND(F.lit(MASK16))
    return high.bitwiseOR(qfi.cast("bigint").bitwiseAND(F.lit(0xF)))


def namespaced_bucket(bucket: Column, qid: Column, width: int) -> Column:
    """Register index of a bucket when every queue owns a range of ``width`` entries."""
    return bucket + F.when(qid.between(0, 7), qid * width).otherwise(0)


def register_queue(qid: Column) -> Column:
    """Queue whose registers count a packet: unknown queues share those of queue 0."""
    return F.when(qid.between(0, 7), qid).otherwise(0).cast("int")


def window_number(path: Column) -> Column:
    """Window number in a file name, -1 when the name has another form."""
    digits = F.nullif(F.regexp_extract(path, WINDOW_FILE_PATTERN, 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def teid_from_hex(text: Column) -> Column:
    """``0x1f`` to 31."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("bigint")


def teid_to_hex(teid: Column) -> Column:
    """31 to ``0x1f``."""
    return F.concat(F.lit("0x"), F.lower(F.hex(teid.cast("bigint"))))


def parse_int_list(text: Column) -> Column:
    """Integers of a comma-separated list; anything else in it is skipped."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part).try_cast("int"))
    return F.filter(parts, lambda x: x.isNotNull())


def parse_qfi_map(text: Column) -> Column:
    """``3:6,5:4`` to a map of integers; a malformed pair fails the query."""
    pairs = F.filter(
        F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != ""
    )

    def entry(pair: Column) -> Column:
        sides = F.transform(F.split(pair, ":"), lambda side: F.trim(side).try_cast("int"))
        good = (F.size(sides) == 2) & F.forall(sides, lambda side: side.isNotNull())
        problem = F.raise_error(F.concat(F.lit("bad class map entry: "), pair))
        key = F.when(good, F.get(sides, F.lit(0))).otherwise(problem.cast("int"))
        return F.struct(key.alias("key"), F.get(sides, F.lit(1)).alias("value"))

    # A class named twice keeps its last target.
    def put(acc: Column, e: Column) -> Column:
        others = F.map_filter(acc, lambda k, _v: k != e["key"])
        return F.map_concat(others, F.map_from_entries(F.array(e)))

    empty = F.map_from_entries(F.array().cast("array<struct<key:int,value:int>>"))
    return F.aggregate(F.transform(pairs, entry), empty, put)


WHOLE_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def text_number(text: Column) -> Column:
    """Number in a text, null if it is none; a type letter as in ``12d`` makes it none."""
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def numeric_or(text: Column, default: int) -> Column:
    """Whole part of a number in a text, ``default`` if it is none. Whole numbers keep all their digits."""
    whole = F.when(text.rlike(WHOLE_TEXT), F.trim(text).try_cast("bigint"))
    number = text_number(text)
    finite = F.when(F.abs(number) < F.lit(float("inf")), number).cast("bigint")
    return F.coalesce(whole, finite, F.lit(default).cast("bigint"))


def whole_or(df: DataFrame, column: str, default: int) -> Column:
    """Whole part of a column of any type, ``default`` for null, NaN, infinite and non-numeric values.

    A whole-number column is only checked for null: its values are not converted through another type.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(value, F.lit(default)).cast("bigint")
    if isinstance(kind, T.StringType):
        return numeric_or(value, default)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
        return F.coalesce(finite.cast("bigint"), F.lit(default).cast("bigint"))
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def finite_or_zero(value: Column) -> Column:
    """Non-numeric, NaN and infinite values become 0."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(number)


def fixed(column: str, decimals: int) -> Column:
    """Round half up in binary arithmetic, so that other engines can repeat it bit by bit.

    Values too large to have that many decimals in a double stay as they are.
    """
    scale = f"{float(10**decimals)!r}D"
    rounded = f"CAST(floor({column} * {scale} + 0.5D) AS DOUBLE) / {scale}"
    return F.expr(f"IF(abs({column}) < 9e15D / {scale}, {rounded}, {column})")

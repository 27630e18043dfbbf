"""Functions against rows worked out by hand."""

import binascii
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tunnelscope.functions import fields, hashing, series
from tunnelscope.functions import histogram as H


def value(spark, column):
    column = F.expr(column) if isinstance(column, str) else column
    return spark.range(1).select(column.alias("v")).head().v


def array(*xs):
    return f"array({', '.join(f'{float(x)!r}D' for x in xs)})"


COUNTS, EDGES = (0, 4, 4, 2), (10, 20, 40)


@pytest.mark.parametrize(
    "fn, expected",
    [
        (lambda c, e: H.quantile(c, e, 0.5), 25.0),
        (lambda c, e: H.quantile(c, e, 0.95), 40.0),
        (lambda c, e: H.quantile(c, e, 0.0), 0.0),
        (lambda c, e: H.tail_fraction(c, 2), 0.6),
        (lambda c, e: H.head_fraction(c, 2), 0.4),
        (lambda c, e: H.tail_fraction(c, 0), 0.2),
        (lambda c, e: H.exceed_fraction(c, e, "30.0D"), 0.4),
        (lambda c, e: H.below_fraction(c, e, "30.0D"), 0.6),
        (lambda c, e: H.exceed_fraction(c, e, "0.0D"), 1.0),
        (lambda c, e: H.below_fraction(c, e, "0.0D"), 0.0),
        (lambda c, e: H.exceed_fraction(c, e, "50.0D"), 0.0),
        (lambda c, e: H.below_fraction(c, e, "50.0D"), 0.8),
        (lambda c, e: H.exceed_fraction(c, e, "DOUBLE('Infinity')"), 0.0),
    ],
)
def test_histogram(spark, fn, expected):
    assert value(spark, fn(array(*COUNTS), array(*EDGES))) == pytest.approx(expected)


def test_empty_histogram_and_missing_edges(spark):
    zeros, none = array(0, 0, 0, 0), "CAST(array() AS ARRAY<DOUBLE>)"
    assert value(spark, H.quantile(zeros, array(*EDGES), 0.5)) == 0.0
    assert value(spark, H.quantile(array(*COUNTS), none, 0.5)) == 0.0
    assert value(spark, H.exceed_fraction(array(*COUNTS), none, "1D")) == 0.0
    assert value(spark, H.usable_edges(array(1, 2, 3, 4, 5), array(*COUNTS))) == [1, 2, 3]


def test_bin_index(spark):
    for v, b in ((0, 0), (9, 0), (10, 1), (39, 2), (40, 3), (99, 3)):
        assert value(spark, H.bin_index(str(v), array(*EDGES), 3)) == b


@pytest.mark.parametrize("row, crc", list(enumerate([2979898411, 2059499406, 4233430304, 923391621])))
def test_crc_of_known_flow(spark, row, crc):
    assert value(spark, hashing.flow_crc("57", "8", str(row))) == crc


def test_crc_of_random_flows(spark):
    rng = random.Random(5)
    flows = [(rng.randrange(2**32), rng.randrange(256), rng.randrange(4)) for _ in range(200)]
    flows += [(0, 0, 0), (2**32 - 1, 255, 3)]
    df = spark.createDataFrame(flows, "teid bigint, qfi int, row int")
    got = df.select("*", hashing.flow_crc("teid", "qfi", "row").alias("c"))
    for r in got.collect():
        assert r.c == binascii.crc32(bytes([r.row]) + struct.pack("!IB", r.teid, r.qfi))


def test_series(spark):
    xs = array(0, 2, 4, 1, 3)
    assert value(spark, series.median(array(0, 2, 4, 1))) == 1.5
    assert value(spark, series.ewma(xs)) == pytest.approx(1.9038)
    assert value(spark, series.slope(xs)) == pytest.approx(0.5)
    assert value(spark, series.slope(array(7))) == 0.0
    assert value(spark, series.std_pop(array(7))) == 0.0
    assert value(spark, series.std_pop(xs)) == pytest.approx(math.sqrt(2))
    assert value(spark, series.percentile(xs, 0.95)) == pytest.approx(3.8)
    # median 2, MAD 1
    assert value(spark, series.robust_z(xs, "3.0D", 21)) == pytest.approx(1 / 1.4826)
    assert value(spark, series.robust_z(array(1, 2, 3, 4), "4.0D", 21)) == 0.0
    flat = series.robust_z(array(1, 1, 1, 1, 2), "2.0D", 21)
    assert value(spark, flat) == pytest.approx(1 / 1.4826e-6)


@pytest.mark.parametrize("flags, run", [("001", 1), ("111", 3), ("110", 0), ("0", 0), ("1", 1)])
def test_trailing_run(spark, flags, run):
    assert value(spark, series.trailing_run(f"array({', '.join(str(f == '1') for f in flags)})")) == run


@pytest.mark.parametrize(
    "path, n",
    [
        ("/d/window_12.parquet", 12),
        ("/d/WINDOW_7.CSV", 7),
        ("/d/file=window_3.parquet/part-0.snappy.parquet", 3),
        ("/d/window_.csv", -1),
        ("/d/rewindow_5.csv", -1),
        ("/d/window_5.txt", -1),
    ],
)
def test_window_number(spark, path, n):
    assert value(spark, fields.window_number(F.lit(path))) == n


def test_field_wrapping(spark):
    assert value(spark, fields.iat_q16(F.lit(5), F.lit(10))) == 65531
    assert value(spark, fields.latency_q16(F.lit(2**26 + 1024).cast("bigint"))) == 1
    assert value(spark, fields.qos_flow_index(F.lit(4096), F.lit(3))) == 3
    assert value(spark, fields.namespaced_bucket(F.lit(5), F.lit(8), 512)) == 5


def test_numeric_coercion(spark):
    for text, key in (("12", 12), ("12.9", 12), ("-3", -3), ("x", -1), (None, -1), ("inf", -1), ("12d", -1), ("1e3", 1000), ("9007199254740993", 9007199254740993)):
        assert value(spark, fields.numeric_or(F.lit(text), -1)) == key


def test_class_map(spark):
    assert value(spark, fields.parse_qfi_map(F.lit(" 3:6, 5:4,,3:7"))) == {3: 7, 5: 4}
    assert value(spark, fields.parse_qfi_map(F.lit(""))) == {}
    for bad in ("3", "3:x", "3:4:5"):
        with pytest.raises(Exception, match="bad class map entry"):
            value(spark, fields.parse_qfi_map(F.lit(bad)))


def test_int_list(spark):
    assert value(spark, fields.parse_int_list(F.lit("1, 2,x,,3"))) == [1, 2, 3]

"""Explicit schemas of the files the pipeline reads and writes."""

from pyspark.sql import types as T

from .config import COUNTERS, SketchGeometry


def sketch_schema(geometry: SketchGeometry) -> T.StructType:
    """Usual columns inside one sketch-window parquet file (the window number is in its name)."""
    keys = [T.StructField(c, T.LongType()) for c in ("qid", "row", "bucket")]
    bins = geometry.lat_columns + geometry.iat_columns
    return T.StructType(keys + [T.StructField(c, T.LongType()) for c in bins + COUNTERS])


# Read as text: a malformed key must become -1, not fail the scan.
FLOW_KEY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("teid", "qfi", "qid")])

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("window", T.IntegerType()),
        T.StructField("qfi", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("thr", T.DoubleType()),
        T.StructField("pred", T.IntegerType()),
        T.StructField("debounced", T.IntegerType()),
    ]
)

BINS_SCHEMA = T.StructType(
    [
        T.StructField(
            "bins",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("latency_us", T.ArrayType(T.DoubleType())),
                        T.StructField("iat_us", T.ArrayType(T.DoubleType())),
                    ]
                ),
            ),
        )
    ]
)

BUNDLE_SCHEMA = T.StructType(
    [
        T.StructField("feat_cols", T.ArrayType(T.StringType())),
        T.StructField("thr_global", T.DoubleType()),
        T.StructField("thr_map", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "debounce",
            T.StructType([T.StructField("k", T.IntegerType()), T.StructField("h", T.DoubleType())]),
        ),
    ]
)

# The two log dialects share one schema; a field of the other dialect is null.
INJECTION_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("episode_id", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField(
            "actors",
            T.StructType(
                [
                    T.StructField("qfi", T.IntegerType()),
                    T.StructField("teids", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "victims",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("teid", T.StringType()),
                        T.StructField("ue_idx", T.IntegerType()),
                        T.StructField("victim_qfi", T.IntegerType()),
                        T.StructField("fake_qfi", T.IntegerType()),
                        T.StructField("pcap_fake", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

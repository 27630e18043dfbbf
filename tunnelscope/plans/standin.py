"""Packets derived from the ``events`` and ``lineitem`` tables, which stand in for switch traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QIDS_PER_SWITCH, REQUEUE_QUEUE, PipelineConfig, SketchGeometry
from ..functions.fields import MASK48
from ..operators.packets import mapped_queue, policing_action
from ..operators.sketch import build, flow_keys
from ..session import cut
from ..sources.settings import same_bins

FIRST_US = 1_704_067_200_000_000
WINDOW_US = 21_600_000_000
CLASS_OF_TYPE = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
LAT_EDGES = [500, 1000, 2000, 4000, 8000, 16000, 32000]
IAT_EDGES = [600, 2400, 6000, 12000, 18000, 28000, 42000]

CONFIG = PipelineConfig(
    geometry=SketchGeometry(depth=3, width=16),
    window_secs=21600.0,
    thr_global=0.5,
    thr_map={1: 0.5, 2: 0.55, 3: 0.45},
    debounce_k=2,
    debounce_h=0.8,
)

# A small ensemble over engineered features, in the shape of the public model file.
FEAT_COLS = [
    "qfi_red_bw_share",
    "rz_qfi_bw_total",
    "feat_lat_p95_ms",
    "roll5_max_qfi_teid_hhi",
    "zS_qfi_yellow_bw_share",
    "ewma_qfi_yellow_bw_share",
]


def stump(feature: int, at: float, low: float, high: float) -> dict:
    return {
        "left": [1, -1, -1],
        "right": [2, -1, -1],
        "feature": [feature, 0, 0],
        "value": [at, low, high],
    }


MODEL = {
    "base_margin": 0.0,
    "trees": [
        stump(0, 0.09, -1.2, 1.4),
        stump(1, 0.8, -0.9, 1.1),
        {
            "left": [1, 3, -1, -1, -1],
            "right": [2, 4, -1, -1, -1],
            "feature": [2, 3, 0, 0, 0],
            "value": [18.5, 0.22, 0.7, -0.6, 0.3],
        },
        stump(4, 0.5, -0.5, 0.8),
        stump(5, 0.3, -0.4, 0.9),
    ],
}


def large_model(trees: int = 80, levels: int = 5) -> dict:
    """Full trees over two features, a share and a byte count, by rule: 5,040 nodes."""
    inner, nodes = 2**levels - 1, 2 ** (levels + 1) - 1
    found = []
    for t in range(trees):
        feature = [(t + n) % 2 if n < inner else 0 for n in range(nodes)]
        splits = [((t * 29 + n * 11) % 101) * 400.0 if feature[n] else (t * 31 + n * 17) % 97 / 97 for n in range(inner)]
        leaves = [((t * 13 + n * 7) % 21 - 10) / 64 for n in range(inner, nodes)]
        found.append({
            "left": [2 * n + 1 if n < inner else -1 for n in range(nodes)],
            "right": [2 * n + 2 if n < inner else -1 for n in range(nodes)],
            "feature": feature,
            "value": splits + leaves,
        })
    return {"base_margin": 0.25, "trees": found}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    days = f"CAST(unix_date(CAST({column} AS DATE)) AS BIGINT) * 86400000000"
    minutes = f"CAST(hour({column}) * 60 + minute({column}) AS BIGINT) * 60000000"
    seconds = f"CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)"
    return F.expr(f"{days} + {minutes} + {seconds}")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event."""
    classes = " ".join(f"WHEN '{kind}' THEN {qfi}" for kind, qfi in CLASS_OF_TYPE.items())
    events = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("packet_id"),
        micros("ts").alias("ts_us"),
        F.expr("user_id % 8 AS teid"),
        F.expr(f"CASE event_type {classes} END AS qfi"),
        F.expr("floor(value * 100000D + 0.5D) AS hop_latency_ns"),
        F.expr("CASE WHEN value < 60 THEN 0 WHEN value < 150 THEN 1 ELSE 3 END AS meter_color"),
        F.expr(r"CAST(regexp_extract(props, r'(\d+)', 1) AS BIGINT) * 13 + 64 AS packet_length"),
    )
    requeued = policing_action(F.col("meter_color")) == "requeue"
    return events.withColumns(
        {
            "window": F.expr(f"CAST(floor((ts_us - {FIRST_US}) / {WINDOW_US}) AS INT)"),
            "egress_qid": F.when(requeued, REQUEUE_QUEUE).otherwise(mapped_queue(F.col("qfi"))),
            "ingress_tstamp_ns": F.expr(f"((ts_us * 1024) div 1000000) & {MASK48}L"),
        }
    )


BINS = same_bins(LAT_EDGES, IAT_EDGES, QIDS_PER_SWITCH)
# A window of stand-in packets is nearly empty, so a slice spans several.
SLICE_US = 15 * WINDOW_US


def sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete sketch of the packets, written once."""
    built = build(packets(spark, sf_dir), BINS, CONFIG.geometry, SLICE_US)
    return cut(built, "sketch")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_keys(packets(spark, sf_dir))


def lineitem_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger load for counters: orders are tunnels, shipping days are windows."""
    return read(spark, sf_dir, "lineitem").select(
        F.unix_date(F.to_date("l_shipdate")).alias("window"),
        F.col("l_orderkey").alias("teid"),
        (F.col("l_linenumber") % 9 + 1).cast("int").alias("qfi"),
        (F.col("l_linenumber") % 8).cast("int").alias("egress_qid"),
        F.lit(0).alias("meter_color"),
        F.col("l_quantity").cast("bigint").alias("packet_length"),
    )

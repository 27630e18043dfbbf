"""Building Count-Min sketches with latency and inter-arrival histograms from packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLOR_GREEN, COLOR_RED, COUNTERS, BinEdges, SketchGeometry
from ..functions.fields import iat_q16, latency_q16, register_queue, switch_tick
from ..functions.hashing import flow_bucket
from ..functions.histogram import bin_index
from ..plans.slices import previous_value

FLOW = ["window", "qid", "teid", "qfi"]
CELL = ["window", "qid", "row", "bucket"]
ORDER = ["ts_us", "packet_id"]


def _forwarded() -> Column:
    return F.col("meter_color") != COLOR_RED


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def _numbered(packets: DataFrame) -> DataFrame:
    return packets.withColumn("qid", register_queue(F.col("egress_qid")))


def _spread(flows: DataFrame, geometry: SketchGeometry) -> DataFrame:
    """One row per hash row, with the bucket the flow falls into."""
    rows = flows.withColumn("row", F.expr(f"explode(sequence(0, {geometry.depth - 1}))"))
    return rows.withColumn("bucket", flow_bucket("teid", "qfi", "row", geometry))


def _to_cells(per_flow: DataFrame, geometry: SketchGeometry, measures: list[str]) -> DataFrame:
    return _spread(per_flow, geometry).groupBy(*CELL).agg(*[F.sum(m).alias(m) for m in measures])


def traffic(packets: DataFrame, geometry: SketchGeometry) -> DataFrame:
    """Packet and byte counters per cell.

    Counters add up, so packets are summed per flow before each flow is copied to its hash rows:
    the copies are made of flows, not of packets.
    """
    per_flow = (
        _numbered(packets)
        .where(_forwarded())
        .groupBy(*FLOW)
        .agg(F.count(F.lit(1)).alias("pkt_cnt"), F.sum("packet_length").alias("byte_cnt"))
    )
    return _to_cells(per_flow, geometry, ["pkt_cnt", "byte_cnt"])


def colors(packets: DataFrame, geometry: SketchGeometry) -> DataFrame:
    """Green counter for color 0, yellow for any other forwarded color."""
    green = F.col("meter_color") == COLOR_GREEN
    per_flow = (
        _numbered(packets)
        .where(_forwarded())
        .groupBy(*FLOW)
        .agg(_count(green).alias("green_cnt"), _count(~green).alias("yellow_cnt"))
    )
    return _to_cells(per_flow, geometry, ["green_cnt", "yellow_cnt"])


def _with_latency_bin(packets: DataFrame, edges: BinEdges, geometry: SketchGeometry) -> DataFrame:
    value = latency_q16(F.col("hop_latency_ns"))
    last = geometry.lat_bins - 1
    binned = bin_index("_value", "_edges", last)
    return (
        _numbered(packets)
        .withColumns({"_edges": F.expr(edges.latency("qid")), "_value": value})
        # A queue without installed ranges misses, and a latency miss counts in the last bin.
        .withColumn("lat_bin", F.expr(f"IF(_edges IS NULL, {last}, {binned})"))
        .drop("_edges", "_value")
    )


def _latency_counts(geometry: SketchGeometry) -> list[Column]:
    kept = f"meter_color <> {COLOR_RED}"
    return [
        F.expr(f"count_if({kept} AND lat_bin = {i}) AS {c}")
        for i, c in enumerate(geometry.lat_columns)
    ]


def latency_histogram(
    packets: DataFrame, edges: BinEdges, geometry: SketchGeometry
) -> DataFrame:
    """Latency bins per cell."""
    per_flow = (
        _with_latency_bin(packets.where(_forwarded()), edges, geometry)
        .groupBy(*FLOW)
        .agg(*_latency_counts(geometry))
    )
    return _to_cells(per_flow, geometry, geometry.lat_columns)


def bucket_gaps(packets: DataFrame, geometry: SketchGeometry, slice_us: int) -> DataFrame:
    """Inter-arrival time of each forwarded packet in each bucket it is hashed to.

    The previous packet is that of the bucket, whichever flow it belongs to, and may lie in an
    earlier window; before the first packet the register holds 0. Each bucket's series is split
    into time slices of ``slice_us``, so a bucket with a large part of all packets is many units of
    work. The last tick of a slice comes from one row per flow, so only the per-packet rows
    themselves are copied to the hash rows.
    """
    slim = _numbered(packets).where(_forwarded()).select(
        *FLOW,
        *ORDER,
        switch_tick(F.col("ingress_tstamp_ns")).alias("tick"),
        F.floor(F.col("ts_us") / slice_us).alias("_slice"),
    )
    per_flow = slim.groupBy("qid", "teid", "qfi", "_slice").agg(
        F.max(F.struct(*ORDER, "tick")).alias("_at")
    )
    last = (
        _spread(per_flow, geometry)
        .groupBy("qid", "row", "bucket", "_slice")
        .agg(F.max("_at")["tick"].alias("_last"))
    )
    linked = previous_value(
        _spread(slim, geometry),
        ["qid", "row", "bucket"],
        ORDER,
        F.col("_slice"),
        "tick",
        "previous",
        last,
    )
    gap = iat_q16(F.col("tick"), F.coalesce("previous", F.lit(0)))
    return linked.withColumn("iat", gap).drop("previous")


def iat_histogram(
    packets: DataFrame, edges: BinEdges, geometry: SketchGeometry, slice_us: int
) -> DataFrame:
    """Inter-arrival bins per cell."""
    binned = bin_index("iat", "_edges", geometry.iat_bins - 1)
    counts = [F.expr(f"count_if(iat_bin = {i}) AS {c}") for i, c in enumerate(geometry.iat_columns)]
    return (
        bucket_gaps(packets, geometry, slice_us)
        .withColumn("_edges", F.expr(edges.arrival("qid")))
        # A queue without installed ranges misses, and an inter-arrival miss counts in the first bin.
        .withColumn("iat_bin", F.expr(f"IF(_edges IS NULL, 0, {binned})"))
        .groupBy(*CELL)
        .agg(*counts)
    )


def build(
    packets: DataFrame, edges: BinEdges, geometry: SketchGeometry, slice_us: int
) -> DataFrame:
    """Complete sketch: one row per (window, queue, hash row, bucket) that saw a packet.

    Dropped packets count only in ``drop_cnt``. All additive measures share one pass over the
    packets; the inter-arrival bins are added by a union and a final sum per cell. ``slice_us`` is
    the time slice of ``bucket_gaps``, such as the length of a window.
    """
    kept = f"(meter_color <> {COLOR_RED})"
    per_flow = (
        _with_latency_bin(packets, edges, geometry)
        .groupBy(*FLOW)
        .agg(
            *_latency_counts(geometry),
            F.expr(f"count_if({kept}) AS pkt_cnt"),
            F.expr(f"sum(IF({kept}, packet_length, 0)) AS byte_cnt"),
            F.expr(f"count_if({kept} AND meter_color = {COLOR_GREEN}) AS green_cnt"),
            F.expr(f"count_if({kept} AND meter_color <> {COLOR_GREEN}) AS yellow_cnt"),
            F.expr(f"count_if(NOT {kept}) AS drop_cnt"),
        )
    )
    additive = _to_cells(per_flow, geometry, geometry.lat_columns + COUNTERS)
    gaps = iat_histogram(packets, edges, geometry, slice_us)
    both = additive.unionByName(gaps, allowMissingColumns=True)
    sums = [F.expr(f"coalesce(sum({m}), 0L) AS {m}") for m in geometry.measures]
    return both.groupBy(*CELL).agg(*sums)


def flow_keys(packets: DataFrame) -> DataFrame:
    """Flows present in each window, dropped packets included."""
    return packets.select(
        "window", "teid", "qfi", F.col("egress_qid").alias("qid")
    ).dropDuplicates(["window", "teid", "qfi", "qid"])

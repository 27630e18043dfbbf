"""Features per tunnel and class: rates, latency and inter-arrival statistics, color shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    COUNTERS,
    IAT_HEAD_BINS,
    IAT_THRESHOLD_Q,
    LATENCY_TAIL_BINS,
    LATENCY_THRESHOLD_Q,
    THRESHOLD_LOOKBACK,
    BinEdges,
    PipelineConfig,
)
from ..functions import histogram as H
from ..functions import series
from ..plans.slices import history_blocks

TUNNEL = ["window", "qfi", "teid"]

STATS = ["lat_p50_ms", "lat_p95_ms", "lat_tail_frac", "iat_p10_us", "iat_p50_us", "iat_head_frac"]


def queue_stats() -> dict[str, str]:
    """Statistics of one queue's histograms."""
    return {
        "lat_p50_ms": H.quantile_of("lat_bins", 0.50) + " / 1000",
        "lat_p95_ms": H.quantile_of("lat_bins", 0.95) + " / 1000",
        "lat_tail_frac": H.tail_fraction("lat", LATENCY_TAIL_BINS),
        "iat_p10_us": H.quantile_of("iat_bins", 0.10),
        "iat_p50_us": H.quantile_of("iat_bins", 0.50),
        "iat_head_frac": H.head_fraction("iat", IAT_HEAD_BINS),
    }


def color_packets() -> Column:
    return F.col("green_cnt") + F.col("yellow_cnt") + F.col("drop_cnt")


def per_queue(recon: DataFrame, edges: BinEdges, config: PipelineConfig) -> DataFrame:
    """Flow estimates with folded histograms, with and without bin limits, and the flow's weight.

    The weight is the packet count, or the latency bins' sum if that is not positive.
    """
    geometry = config.geometry
    weight = f"IF(pkt_cnt > 0, CAST(pkt_cnt AS DOUBLE), {H.total('lat')})"
    return (
        recon.withColumns({"lat": F.array(*geometry.lat_columns), "iat": F.array(*geometry.iat_columns)})
        .withColumns(
            {
                "_lat_edges": F.expr(H.usable_edges(edges.latency("qid"), "lat")),
                "_iat_edges": F.expr(H.usable_edges(edges.arrival("qid"), "iat")),
                "weight": F.expr(weight),
            }
        )
        .withColumns(
            {
                "lat_bins": F.expr(H.bins("lat", "_lat_edges")),
                "iat_bins": F.expr(H.bins("iat", "_iat_edges")),
            }
        )
        .drop(*geometry.lat_columns, *geometry.iat_columns, "_lat_edges", "_iat_edges")
    )


def tunnel_windows(recon: DataFrame, edges: BinEdges, config: PipelineConfig) -> DataFrame:
    """One row per (window, class, tunnel): counters, queue-weighted statistics, usable queues.

    Statistics of the queues are averaged; their bins are never added. ``queues`` keeps the
    histograms of queues with traffic, at most one entry per queue of the switch.
    """
    usable = F.when(F.col("weight") > 0, F.struct("qid", "weight", "lat_bins", "iat_bins"))
    heavy = "FILTER (WHERE weight > 0)"
    means = [
        F.expr(f"coalesce(sum({s} * weight) {heavy} / sum(weight) {heavy}, 0D) AS {s}") for s in STATS
    ]
    return (
        per_queue(recon, edges, config)
        .withColumns({name: F.expr(text) for name, text in queue_stats().items()})
        .groupBy("slice", *config.run, *TUNNEL)
        .agg(
            *[F.expr(f"sum({c}) AS {c}") for c in COUNTERS],
            *means,
            F.sort_array(F.collect_list(usable)).alias("queues"),
        )
    )


def rolling_thresholds(tunnels: DataFrame, config: PipelineConfig) -> DataFrame:
    """Add ``thr_lat_ms`` and ``thr_iat_us``: percentiles of the tunnel's five rows before this one.

    The first row of a tunnel has no history and gets 0.
    """
    blocks = history_blocks(
        tunnels,
        [*config.run, "qfi", "teid"],
        "window",
        F.floor(F.col("window") / config.slice_windows),
        config.block_rows,
        THRESHOLD_LOOKBACK,
    )
    earlier = (
        Window.partitionBy(*config.run, "qfi", "teid", "_block")
        .orderBy("window")
        .rowsBetween(-THRESHOLD_LOOKBACK, -1)
    )

    def threshold(column: str, q: float) -> Column:
        return F.expr(f"coalesce({series.percentile(column, q)}, 0D)")

    return (
        blocks.withColumns(
            {
                "_lat": F.collect_list("lat_p95_ms").over(earlier),
                "_iat": F.collect_list("iat_p10_us").over(earlier),
            }
        )
        .where(~F.col("_history"))
        .withColumns(
            {
                "thr_lat_ms": threshold("_lat", LATENCY_THRESHOLD_Q),
                "thr_iat_us": threshold("_iat", IAT_THRESHOLD_Q),
            }
        )
        .drop("_block", "_history", "_lat", "_iat")
    )


def class_color_totals(tunnels: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Policed packets and number of active tunnels per (window, class)."""
    return tunnels.groupBy(*run, "window", "qfi").agg(
        F.sum(color_packets()).alias("class_pkts"),
        F.count_if(color_packets() > 0).cast("bigint").alias("active_teids"),
    )


def traffic_rates(config: PipelineConfig) -> dict[str, Column]:
    """Rate expressions over summed counters."""
    secs = config.window_secs
    if secs <= 0:
        return {"feat_bw_mbps": F.lit(0.0), "feat_pps": F.lit(0.0)}
    return {
        "feat_bw_mbps": F.col("byte_cnt") * 8.0 / (secs * 1e6),
        "feat_pps": F.col("pkt_cnt") / F.lit(secs),
    }


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def tunnel_features(tunnels: DataFrame, config: PipelineConfig) -> DataFrame:
    """The 14 features of each (window, class, tunnel).

    Thresholds and class totals are worked out without the histograms, which are then joined once.
    ``tunnels`` is read several times: pass a table written with ``session.cut``.
    """
    narrow = rolling_thresholds(tunnels.drop("queues"), config)
    run = config.run
    totals = class_color_totals(tunnels, run)
    with_queues = narrow.join(totals, [*run, "window", "qfi"]).join(
        tunnels.select(*run, *TUNNEL, "queues"), [*run, *TUNNEL]
    )

    def queue_mean(fraction: str) -> Column:
        hit = f"aggregate(queues, 0D, (sum, q) -> sum + q.weight * {fraction})"
        whole = "aggregate(queues, 0D, (sum, q) -> sum + q.weight)"
        return F.expr(f"IF(size(queues) > 0, {hit} / {whole}, 0D)")

    over = queue_mean(H.exceed_of("q.lat_bins", "(thr_lat_ms * 1000)"))
    under = queue_mean(H.below_of("q.iat_bins", "thr_iat_us"))
    rates = traffic_rates(config)
    return with_queues.select(
        *run,
        "window",
        "qfi",
        "teid",
        rates["feat_bw_mbps"].alias("feat_bw_mbps"),
        rates["feat_pps"].alias("feat_pps"),
        F.col("lat_p50_ms").alias("feat_lat_p50_ms"),
        F.col("lat_p95_ms").alias("feat_lat_p95_ms"),
        F.col("lat_tail_frac").alias("feat_lat_tail_frac"),
        over.alias("feat_lat_roll_p95_exceed_frac"),
        F.col("iat_p10_us").alias("feat_iat_p10_us"),
        F.col("iat_p50_us").alias("feat_iat_p50_us"),
        F.col("iat_head_frac").alias("feat_iat_head_frac"),
        under.alias("feat_iat_roll_p10_below_frac"),
        _ratio(F.col("yellow_cnt"), color_packets()).alias("feat_yellow_frac"),
        _ratio(F.col("drop_cnt"), color_packets()).alias("feat_red_frac"),
        _ratio(color_packets(), F.col("class_pkts")).alias("feat_teid_share"),
        F.col("active_teids").alias("feat_qfi_teid_count"),
    )

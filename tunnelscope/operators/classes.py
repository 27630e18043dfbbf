"""Features per QoS class: roll-up of the tunnels, concentration, colored bandwidth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIVE_MBPS
from ..functions.fields import fixed
from ..plans.medians import grouped_medians, runner_up

CLASS = ["window", "qfi"]
SUM_SUFFIXES = ("_mbps", "_pps")
MAX_SUFFIXES = ("_ms", "_frac")

CLASS_COLUMNS = [
    "qfi_bw_total",
    "qfi_teid_hhi",
    "qfi_teid_top1_share",
    "qfi_teid_top2_share",
    "qfi_share_entropy",
    "qfi_frac_teids_active",
    "qfi_yellow_bw_share",
    "qfi_red_bw_share",
]


def _zero_unless(total: Column, value: Column) -> Column:
    return F.coalesce(F.when(total > 0, value), F.lit(0.0))


def concentration() -> dict[str, Column]:
    """How a class's bandwidth spreads over its tunnels, as aggregates that combine map-side.

    With T the sum over tunnels of b, the sum of squared shares is sum(b²)/T², and the entropy of
    the shares is ln T - sum(b ln b)/T, so no tunnel row needs T beforehand.
    """
    bw = F.coalesce(F.col("feat_bw_mbps").cast("double"), F.lit(0.0))
    total = F.sum(bw)
    log_sum = F.sum(F.when(bw > 0, bw * F.ln(bw)))
    return {
        "qfi_bw_total": total,
        "qfi_teid_hhi": _zero_unless(total, F.sum(bw * bw) / (total * total)),
        "qfi_teid_top1_share": _zero_unless(total, F.max(bw) / total),
        "qfi_share_entropy": _zero_unless(total, F.ln(total) - log_sum / total),
        "qfi_frac_teids_active": F.count_if(bw > ACTIVE_MBPS) / F.count(F.lit(1)),
    }


def colored_bandwidth() -> dict[str, Column]:
    """Share of a class's bandwidth that was marked yellow or red."""
    bw = F.coalesce(F.col("feat_bw_mbps").cast("double"), F.lit(0.0))
    total = F.sum(bw)
    return {
        f"qfi_{color}_bw_share": _zero_unless(
            total, F.sum(bw * F.coalesce(f"feat_{color}_frac", F.lit(0.0))) / total
        )
        for color in ("yellow", "red")
    }


def rollup_rules(columns: list[str]) -> tuple[dict[str, Column], list[str]]:
    """Sums and maxima by column suffix, and the columns left over for a median."""
    features = [c for c in columns if c.startswith("feat_")]
    direct, medians = {}, []
    for c in features:
        if c.endswith(SUM_SUFFIXES):
            direct[c] = F.sum(c)
        elif c.endswith(MAX_SUFFIXES):
            direct[c] = F.max(c)
        else:
            medians.append(c)
    return direct, medians


def aggregate_classes(features: DataFrame, decimals: int | None = 12, run: tuple[str, ...] = ()) -> DataFrame:
    """One row per (window, class) from tunnel features.

    Everything that combines map-side is one aggregation. The runner-up tunnel and the medians need
    an order; they come from plans that never bring a whole class into one task. ``features`` is
    read three times: pass a table written with ``session.cut``.
    """
    keys = [*run, *CLASS]
    valid = features.where(F.col("qfi") >= 0)
    direct, median_columns = rollup_rules(features.columns)
    sums = {**direct, **concentration(), **colored_bandwidth()}
    out = valid.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    second = runner_up(valid, keys, "feat_bw_mbps", "teid", "_second")
    out = out.join(second, keys, "left")
    if median_columns:
        out = out.join(grouped_medians(valid, keys, median_columns), keys, "left")
    top2 = _zero_unless(F.col("qfi_bw_total"), F.col("_second") / F.col("qfi_bw_total"))
    out = out.withColumn("qfi_teid_top2_share", top2)
    names = [c for c in features.columns if c.startswith("feat_")] + CLASS_COLUMNS
    if decimals is None:
        return out.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return out.select(
        *keys, *[fixed(f"CAST({c} AS DOUBLE)", decimals).alias(c) for c in names]
    )

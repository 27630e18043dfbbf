"""Bin edges and model bundles from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinEdges, PipelineConfig, SketchGeometry
from ..schemas import BINS_SCHEMA, BUNDLE_SCHEMA


def bins_from_json(text: Column) -> Column:
    return F.from_json(text, BINS_SCHEMA, {"mode": "FAILFAST"})


def bins_table(raw: DataFrame) -> DataFrame:
    """One row per queue (qid text, latency edges, inter-arrival edges) from a ``bins`` map."""
    return raw.select(F.explode("bins").alias("qid_text", "edges")).select(
        "qid_text",
        F.trim("qid_text").try_cast("int").alias("qid"),
        F.col("edges.latency_us").alias("lat_edges"),
        F.col("edges.iat_us").alias("iat_edges"),
    )


def _bad_edges(edges: Column) -> Column:
    inf = F.lit(float("inf"))
    finite = F.forall(edges, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    step = F.transform(edges, lambda x, i: (i == 0) | (x > F.get(edges, i - 1)))
    rising = F.forall(step, lambda ok: ok)
    return (
        F.when(edges.isNull(), "not a list")
        .when(~finite, "not finite")
        .when(~rising, "not increasing")
    )


def bin_problems(table: DataFrame) -> DataFrame:
    """Every rule an edge table breaks, as (qid_text, problem); empty for a good one."""
    inf = F.lit(float("inf"))
    per_row = F.array_compact(
        F.array(
            F.when(F.col("qid").isNull(), "queue is not an integer"),
            F.concat(F.lit("latency_us: "), _bad_edges(F.col("lat_edges"))),
            F.concat(F.lit("iat_us: "), _bad_edges(F.col("iat_edges"))),
        )
    )
    sizes = table.agg(
        (F.min(F.size("lat_edges")) != F.max(F.size("lat_edges"))).alias("lat"),
        (F.min(F.size("iat_edges")) != F.max(F.size("iat_edges"))).alias("iat"),
    )
    overall = F.array_compact(
        F.array(
            F.when(F.col("lat"), "latency bin counts differ"),
            F.when(F.col("iat"), "iat bin counts differ"),
        )
    )
    rows = table.select("qid_text", F.explode(per_row).alias("problem"))
    return rows.unionByName(
        sizes.select(F.lit("*").alias("qid_text"), F.explode(overall).alias("problem"))
    )


def read_bins(spark: SparkSession, path: str) -> BinEdges:
    """Edges of a settings file; ValueError if it breaks a rule."""
    raw = spark.read.schema(BINS_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    table = bins_table(raw)
    broken = bin_problems(table).limit(20).collect()
    if broken:
        raise ValueError(f"bad bin edges in {path}: {[tuple(r) for r in broken]}")
    # One settings file: a row per queue it names.
    rows = table.collect()
    if not rows:
        raise ValueError(f"{path} has no 'bins' object with queue entries")
    return BinEdges(
        {r.qid: tuple(r.lat_edges) for r in rows}, {r.qid: tuple(r.iat_edges) for r in rows}
    )


def same_bins(lat_edges: list[float], iat_edges: list[float], queues: int) -> BinEdges:
    """The same edges for all queues."""
    lat, iat = (tuple(float(e) for e in es) for es in (lat_edges, iat_edges))
    return BinEdges({q: lat for q in range(queues)}, {q: iat for q in range(queues)})


def bundle_from_json(text: Column) -> Column:
    return F.from_json(text, BUNDLE_SCHEMA)


def threshold_table(bundle: DataFrame) -> DataFrame:
    """Thresholds per class (qfi, thr) of a bundle."""
    return bundle.select(F.explode("thr_map").alias("qfi_text", "thr")).select(
        F.col("qfi_text").cast("int").alias("qfi"), "thr"
    )


def read_bundle(
    spark: SparkSession, path: str, geometry: SketchGeometry | None = None, **settings
) -> tuple[list[str], PipelineConfig]:
    """Model inputs and run settings from a bundle file (one small JSON object)."""
    row = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).json(path).head()
    if row is None or row.feat_cols is None or row.thr_global is None:
        raise ValueError(f"{path} needs feat_cols and thr_global")
    debounce = row.debounce
    k = debounce.k if debounce and debounce.k is not None else 1
    h = debounce.h if debounce and debounce.h is not None else 1.0
    config = PipelineConfig(
        geometry=geometry or SketchGeometry(),
        thr_global=row.thr_global,
        thr_map={int(q): t for q, t in (row.thr_map or {}).items()},
        debounce_k=k,
        debounce_h=h,
        **settings,
    )
    return list(row.feat_cols), config

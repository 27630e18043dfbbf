"""Reading flow estimates out of sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SketchGeometry
from ..functions.fields import whole_or
from ..functions.hashing import flow_bucket, valid_flow_key

FLOW_KEY = ["window", "teid", "qfi", "qid"]


def clean_sketch(sketch: DataFrame, geometry: SketchGeometry, run: tuple[str, ...] = ()) -> DataFrame:
    """Whole-number columns: bad keys become -1, bad or missing measures 0."""
    missing = [c for c in ("window", "qid", "row", "bucket") if c not in sketch.columns]
    if missing:
        raise ValueError(f"sketch table lacks key columns {missing}")
    keys = [whole_or(sketch, c, -1).cast("int").alias(c) for c in ("qid", "row", "bucket")]
    zero = F.lit(0).cast("bigint")
    measures = [
        (whole_or(sketch, m, 0) if m in sketch.columns else zero).alias(m)
        for m in geometry.measures
    ]
    place = ["position"] if "position" in sketch.columns else []
    return sketch.select(*run, F.col("window").cast("int").alias("window"), *keys, *measures, *place)


def clean_flow_keys(keys: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Whole-number keys with bad values as -1, and ``valid`` for those that can be hashed."""
    missing = [c for c in FLOW_KEY if c not in keys.columns]
    if missing:
        raise ValueError(f"flow-key table lacks columns {missing}")
    typed = keys.select(
        *run,
        F.col("window").cast("int").alias("window"),
        whole_or(keys, "teid", -1).alias("teid"),
        whole_or(keys, "qfi", -1).cast("int").alias("qfi"),
        whole_or(keys, "qid", -1).cast("int").alias("qid"),
    )
    return typed.withColumn("valid", valid_flow_key(F.col("teid"), F.col("qfi")))


def distinct_flow_keys(keys: DataFrame) -> DataFrame:
    """Hashable flow keys, each once per window."""
    return clean_flow_keys(keys).where("valid").drop("valid").dropDuplicates(FLOW_KEY)


def rejected_flow_keys(keys: DataFrame) -> DataFrame:
    """Flow keys that no packet can carry; the caller may log or count them."""
    return clean_flow_keys(keys).where("not valid").drop("valid")


def min_query(
    sketch: DataFrame,
    keys: DataFrame,
    geometry: SketchGeometry,
    slice_windows: int = 4096,
    run: tuple[str, ...] = (),
) -> DataFrame:
    """Estimate of every measure for every flow: its smallest counter over the hash rows.

    A cell that is not in the sketch counts 0, so cells that never counted anything, most of a
    register dump, are left out before the join. ``sketch`` holds each cell once (a register dump
    does) and comes from ``clean_sketch``. Repeated keys need no shuffle of their own: the minimum
    absorbs them. The rows of one flow are brought together by
    (tunnel, class, window slice): later sums per tunnel and window need no further shuffle, and a
    tunnel that never goes away is still spread over its slices.
    """
    probes = (
        clean_flow_keys(keys, run)
        .where("valid")
        .withColumn("row", F.expr(f"explode(sequence(0, {geometry.depth - 1}))"))
        .withColumn("bucket", flow_bucket("teid", "qfi", "row", geometry))
    )
    used = " OR ".join(f"{m} <> 0" for m in geometry.measures)
    found = probes.join(sketch.where(used), [*run, "window", "qid", "row", "bucket"], "left")
    return (
        found.withColumn("slice", F.floor(F.col("window") / slice_windows).cast("int"))
        .repartition(*run, "qfi", "teid", "slice")
        .groupBy("slice", *run, *FLOW_KEY)
        .agg(*[F.expr(f"min(coalesce({m}, 0L)) AS {m}") for m in geometry.measures])
    )
